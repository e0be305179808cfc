"""Suffix-array removal, collocations and conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchlight.llm import phrases, queries, repair, suffixes
from matchlight.llm.common import table

SF = "/root/testdata/sf0.001"


def rows_of(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


# --- removal of repeated strings


def removed_plainly(texts):
    seen, out = Counter(), []
    whole = [(t or "").encode() for t in texts]
    for b in whole:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for b in whole:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, y in zip(b, gone, strict=False) if not y)
        out.append((len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéfgh", k=rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, long = prose(60), prose(400)
    rows = [None, "", "x" * 199, "x" * 200, "y" * 201, "w" * 3000, "le mot " * 600, prose(20), passage, passage]
    for _ in range(150):
        t = prose(rng.randint(0, 120))
        if rng.random() < 0.5:
            t += passage[rng.randrange(100) :] + prose(rng.randint(0, 30))
        if rng.random() < 0.4:
            near = long.split()
            near[rng.randrange(400)] = "q"
            t = " ".join(near[rng.randrange(200) :])
        rows.append(t)
    return rows


@pytest.mark.parametrize("stretches,shard", [(1024, 1 << 21), (3, 3000)])
def test_suffix_dedup_is_brute_force(spark, stretches, shard):
    """With shards of a few stretches, anchors are dealt to several shards and merged."""
    texts = repeating_texts()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, file string, row int")
    got = rows_of(suffixes.report(df, stretches=stretches, shard=shard).orderBy("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_plainly(texts)


def test_suffix_dedup_query_and_empty(spark):
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    want = {(r["doc_id"], *w) for r, w in zip(docs, removed_plainly([r["text"] for r in docs]), strict=True)}
    assert set(rows_of(queries.op11_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert suffixes.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "ab" * 150), (1, "ab" * 150), (None, None)], "doc_id long, text string")
    assert sorted(rows_of(suffixes.report(same), "n_bytes", "n_removed")) == [(0, 0), (300, 300), (300, 300)]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(8):
        base = bytes(rng.choice(b"ab") for _ in range(1500))
        text = b"".join(base[(a := rng.randrange(1200)) : a + rng.randrange(1, 300)] for _ in range(10))
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(np.frombuffer(text, np.uint8), order, np.array([0, 100, 250]))
        for i, j in zip(order[1:], order[:-1], strict=True):
            n = next((n for n in range(200) if text[i + n : i + n + 1] != text[j + n : j + n + 1] or i + n >= len(text)), 200)
            assert shared[i] == n


# --- collocations


def collocations_plainly(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang, t = lang or "und", (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {y[i : i + k] for y, b in found.items() for k in range(2, len(y)) for i in range(len(y) - k + 1) if 100 * b >= 80 * found[y[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_are_brute_force(spark):
    rng = random.Random(4)
    ends = ["", "", "", ".", ",\n", "\t"]
    word = lambda: "".join(rng.choices("abéA", k=rng.randint(1, 2))) + rng.choice(ends)
    rows = [(rng.choice(["a", None, "b"]), " ".join(word() for _ in range(rng.randint(0, 60)))) for _ in range(600)]
    rows += [("c", None), (None, ""), ("a", "x y " * 3000), ("und", "A b"), ("d", " \t.\n")]
    df = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, n int")
    got = phrases.collocations(df, least=30, top=50, size=500, held=1000)
    assert sorted(rows_of(got, *COLLOCATION)) == collocations_plainly(rows, 30, 50)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_collocations_query(spark):
    rows = rows_of(table(spark, "/root/testdata/sf0.01", "documents"), "lang", "text")
    assert sorted(rows_of(queries.op12_phrase_collocations(spark, "/root/testdata/sf0.01"), *COLLOCATION)) == collocations_plainly(rows, 30, 2000)


def test_phrases_of_one_fingerprint_stay_apart(spark, monkeypatch):
    """With a bitmap that is all ones, so that nothing is pruned, the counts are the same."""
    monkeypatch.setattr(phrases, "bitmap_of", lambda prints: np.full(1 << (phrases.BITS - 3), 255, np.uint8))
    rows = [("a", f"x{i % 7} y{i % 3} z") for i in range(300)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(rows_of(got, *COLLOCATION)) == collocations_plainly(rows, 30, 2000)


# --- conversations


def cheapest_plainly(rows):
    """Least (cost, audit) by trying all edits."""
    best = None

    def go(i, out, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for x in "ua":
                go(i, out + x, cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            go(i + 1, out, cost + 2, audit + "D", 0)
            if not must_go:
                go(i + 1, out + (initial or "?"), cost + 5 * truncated, audit + "K", 0)
                for x in "ua":
                    if x != initial:
                        go(i + 1, out + x, cost + 1 + 5 * truncated, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_cheapest_edits():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice("suaasut"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        r = repair.Repair()
        for row in rows:
            r.add(*row)
        assert r.best() == cheapest_plainly(rows)


def cheapest_by_table(rows):
    """Least (cost, audit) over the four states of the roles' pattern."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def insert(best):
        for _ in range(3):
            for (q, x), to in step.items():
                if q in best and x in "ua":
                    best[to] = min(best.get(to, (1 << 60, "")), (best[q][0] + 5, best[q][1] + "I"))
        return best

    best = insert({0: (0, "")})
    for initial, must_go, truncated in rows:
        after = {q: (c + 2, a + "D") for q, (c, a) in best.items()}
        for (q, x), to in step.items():
            if q in best and not must_go and (x == initial or x != "s"):
                c, a = best[q]
                way = (c + 5 * truncated + (x != initial), a + ("K" if x == initial else "R"))
                after[to] = min(after.get(to, (1 << 60, "")), way)
        best = insert(after)
    return min(best[q] for q in (0, 3) if q in best)


def repaired_plainly(rows):
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        groups[conv] += [(turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1)
    out = []
    for conv, got in groups.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in got if t is not None]
        faults, seen = [], set()
        for _, role, text in got:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest_by_table([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(got, faults, strict=True)])
        lines, rest, place = [], iter(got), 0
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(rest)
            if edit != "D":
                role = role if edit == "K" else ("user", "assistant")[place % 2]
                place += role[:1] != "s"
                lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
by_id = lambda r: (r[0] is not None, r[0] or 0)


def test_conversation_repair_query(spark):
    rows = rows_of(table(spark, "/root/testdata/sf0.01", "conversations"), "conv_id", "turn", "role", "text")
    got = rows_of(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01"), *REPAIR)
    assert sorted(got, key=by_id) == sorted(repaired_plainly(rows), key=by_id)


def test_conversation_repair_hard(spark):
    """Nulls, equal turns, odd roles, repeated rows, blank and dropped conversations, one of 700 rows, clashing columns."""
    rng = random.Random(9)
    pick = lambda: (rng.choice(["user", "assistant", "system", None, "", "tool", "s"]), rng.choice(["Yes.", "no", None, " \t", "Oh?! ", "é…", "Yes."]))
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), *pick()) for _ in range(600)]
    rows += [(77, k, *pick()) for k in range(700)] + [(k, 0, "user", "Alone.") for k in range(100, 160)] + [(5, 2, "user", "A."), (5, 2, "user", "A.")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, mark string, copy int, dropped boolean")
    assert sorted(rows_of(repair.report(df), *REPAIR), key=by_id) == sorted(repaired_plainly(rows), key=by_id)
    assert repair.report(df.limit(0)).count() == 0
