"""Operators 11 and 13 against brute force, over awkward rows and at their edges."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.llm import conversations, vectorcodes

# --- 11 ---------------------------------------------------------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    """Plain Lloyd's rounds with a full scan each, in Python integers; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    ints = [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in r[1]] for r in kept]
    parts = [[tuple(v[p * width : (p + 1) * width]) for v in ints] for p in range(4)]
    books = [parts[p][:entries] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            codes = [nearest(x, books[p])[1] for x in parts[p]]
            fresh = list(books[p])
            for j in set(codes):
                own = [x for x, c in zip(parts[p], codes, strict=True) if c == j]
                fresh[j] = tuple(sum(col) // len(own) for col in zip(*own, strict=True))
            books[p] = fresh
    found = [[nearest(parts[p][i], books[p]) for p in range(4)] for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{j:02x}" for _, j in f), e, total[r[2]], digest) for r, f, e in zip(kept, found, error, strict=True) if r[0] is not None), digest


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, ints string, __n int"


@pytest.mark.parametrize("spread_", [0.01, 1.0])
def test_codes_equal_full_scans(spark, spread_):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, spread_), 2) for _ in range(8)], rng.choice([1, 2, None])) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1], 1) for i in range(300)]  # repeated vectors: many ties
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] + [0.0] * 7, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], VECTORS).repartition(5)
    want, _ = brute_codes(rows)
    assert sorted(tuple(r) for r in vectorcodes.codes(df).collect()) == want


def test_codes_at_their_edges(spark):
    make = lambda rows: vectorcodes.codes(spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], VECTORS))
    assert make([]).collect() == []
    few = [(5, [0.5, -0.25, 1.0, 0.0], None), (3, [0.0] * 4, 7), (3, [-1.0] * 4, 7)]
    want, _ = brute_codes(few)
    assert sorted(tuple(r) for r in make(few).collect()) == want
    odd = {r["vec_id"]: r for r in make([*few, (9, [1.0] * 8, 7), (None, [0.1] * 4, 7)]).collect()}
    assert odd[9]["code"] is None and odd[9]["error"] is None and odd[None]["code"] is not None
    assert [r["code"] for r in make([(1, [1.0] * 3, 1), (2, [], 1)]).collect()] == [None, None]
    assert len(make([(1, [3e38, -3e38, 1e30, 0.0], 1), (2, [0.0] * 4, 1)]).collect()) == 2


def test_bounds_skip_scans_and_never_err():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (20, 6))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-40, 40, (4000, 6))).astype(np.int64)
    book = x[:32].copy()
    code, upper, lower = vectorcodes.scan(x, book)
    scans = []
    for _ in range(6):
        fresh = book.copy()
        for j in np.unique(code):
            fresh[j] = x[code == j].sum(axis=0) // (code == j).sum()
        code, upper, lower, n = vectorcodes.assign(x, fresh, code, upper, lower, vectorcodes.moves(book, fresh), vectorcodes.half_gaps(fresh))
        d = ((x[:, None, :] - fresh) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all()
        assert (upper**2 >= d.min(axis=1)).all() and (lower**2 <= np.sort(d, axis=1)[:, 1]).all()
        book = fresh
        scans.append(n)
    assert scans[-1] < 2000  # most rows keep their entry without a scan


def test_codes_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 320")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(tuple(r) for r in vectorcodes.codes(df).collect()) == brute_codes(rows)[0]


# --- 13 ---------------------------------------------------------------------------------------------------------
LEGAL = re.compile(r"(s?(ua)+)?")


def every_edit(signature):
    """The least (cost, audit) among all edit scripts with up to two inserts at a place."""
    best = None
    for edits in itertools.product(*(("D",) if c == "-" else ("D", "K", "u", "a") for c in signature)):
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(signature) + 1):
            roles, audit, cost = "", "", 0
            for i in range(len(signature) + 1):
                roles, audit, cost = roles + inserts[i], audit + "I" * len(inserts[i]), cost + 3 * len(inserts[i])
                if i < len(signature):
                    c, e = signature[i], edits[i]
                    cost += 4 if e == "D" else (0 if e == "K" else 3) + (3 if c.isupper() else 0)
                    audit += e if e in "DK" else "R"
                    roles += "" if e == "D" else c.lower() if e == "K" else e
            if LEGAL.fullmatch(roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solved_signatures_equal_all_scripts(n):
    for signature in map("".join, itertools.product("suaxSUA-", repeat=n)):
        if n < 3 or signature[0] == "S":
            assert conversations.solve(signature) == every_edit(signature), signature


def brute_solve(signature):
    """Least (cost, audit) by comparing whole strings from the back."""
    far = (1 << 40, "")
    after = {"": (0, ""), "s": far, "u": far, "a": (0, "")}
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(t):
        for _ in range(3):
            t = {k: min(t[k], (t[nxt[k]][0] + 3, "I" + t[nxt[k]][1])) for k in t}
        return t

    t = with_inserts(after)
    for c in reversed(signature):
        new = {}
        for k in t:
            found = [(t[k][0] + 4, "D" + t[k][1])]
            if c != "-":
                extra, low = 3 if c.isupper() else 0, c.lower()
                if (low == "s" and k == "") or low == nxt[k]:
                    found.append((t[low][0] + extra, "K" + t[low][1]))
                found.append((t[nxt[k]][0] + 3 + extra, "R" + t[nxt[k]][1]))
            new[k] = min(found)
        t = with_inserts(new)
    return t[""]


def brute_repair(rows):
    """Rows are (conv_id, turn, role, text)."""
    out, convs = [], {}
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        own += [] if kind == 0 else [(t, r, x)] * (2 if kind == 3 else 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, r, x in own:
            rest = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not rest else "duplicate" if (r, x) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((r, x))
        letters = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        code = lambda a, f: "-" if f in ("blank", "duplicate") else (a if a in ("s", "u", "a") else "x").upper() if f else (a if a in ("s", "u", "a") else "x")
        cost, audit = brute_solve("".join(code(a, f) for a, f in zip(letters, faults, strict=True)))
        said, i = [], 0
        for e in audit:
            after = "assistant" if said and said[-1][0][:1] == "u" else "user"
            if e == "I":
                said.append((after, ""))
                continue
            if e != "D":
                said.append((own[i][1] if e == "K" else after, own[i][2]))
            i += 1
        assert i == len(own) and LEGAL.fullmatch("".join(r[0] for r, _ in said))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


ROWS = "conv_id long, turn long, role string, text string, cost string, at string, n string, part string, code string"


def test_repair_equals_brute_force(spark):
    rng, rows = random.Random(9), []
    texts = ["Yes.", "No!", "so it goes", "Why? ", "", " \n", "a" * 30000 + ".", None, "é ünï?", " ", "end.\u0085", "x\n"]
    for c in [*range(150), None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)] + [(501, 7, "user", "same?")] * 40
    rows += [(502, t, "user", f"{t}") for t in range(700)]
    rows.append(next((900 + i, 1, "user", "gone.") for i in range(1000) if zlib.crc32(f"{900 + i}:1".encode()) % 20 == 0))
    rng.shuffle(rows)
    df = spark.createDataFrame([r + (None,) * 5 for r in rows], ROWS).repartition(6)
    got = sorted((tuple(r) for r in conversations.repair(df).collect()), key=repr)
    assert got == brute_repair(rows)
    gone = next(r for r in got if r[0] is not None and r[0] >= 900)
    assert gone[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(df.limit(0)).collect() == []


def test_repair_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in conversations.repair(df).collect()), key=repr) == brute_repair(rows)


def test_signatures_are_solved_once(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(60) for t in range(4)]
    df = spark.createDataFrame([r + (None,) * 5 for r in rows], ROWS)
    found = conversations.signatures(conversations.damaged(df))
    assert found.agg(F.count_distinct("signature")).first()[0] < 40 < found.count()


def test_a_long_signature_is_solved_within_the_stack():
    rng = random.Random(1)
    signature = "".join(rng.choice("suaSUA-x") for _ in range(20000))
    cost, audit = conversations.solve(signature)
    assert (cost, audit) == brute_solve_long(signature)


def brute_solve_long(signature):
    """As ``brute_solve``, by costs from the back and letters from the front."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    close = lambda t: {k: min(t[k], t[nxt[k]] + 3, t[nxt[nxt[k]]] + 6) for k in t}
    costs = [close({"": 0, "s": 1 << 40, "u": 1 << 40, "a": 0})]
    for c in reversed(signature):
        t, new = costs[-1], {}
        for k in t:
            new[k] = 4 + t[k]
            if c != "-":
                extra, low = 3 if c.isupper() else 0, c.lower()
                if (low == "s" and k == "") or low == nxt[k]:
                    new[k] = min(new[k], t[low] + extra)
                new[k] = min(new[k], t[nxt[k]] + 3 + extra)
        costs.append(close(new))
    costs.reverse()
    audit, k = [], ""
    for i in range(len(signature) + 1):
        while True:
            c = signature[i] if i < len(signature) else None
            now, extra = costs[i][k], 3 if c and c.isupper() else 0
            if c and 4 + costs[i + 1][k] == now:
                audit.append("D")
                break
            if costs[i][nxt[k]] + 3 == now:
                audit.append("I")
                k = nxt[k]
                continue
            if c is None:
                break
            low = c.lower()
            if ((low == "s" and k == "") or low == nxt[k]) and costs[i + 1][low] + extra == now:
                audit.append("K")
                k = low
            else:
                audit.append("R")
                k = nxt[k]
            break
    return costs[0][""], "".join(audit)
