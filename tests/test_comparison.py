"""Clause alignment by equi-joins against a plain all-pairs greedy choice."""

import random

from lexfolio import lexicons as lx
from lexfolio.operators import compare

SCHEMA = "pair_id string, side string, i int, number string, heading string, full_text string, words array<string>, heading_words array<string>"


def dice(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else 2 * len(set(a) & set(b)) / (len(a) + len(b))


def greedy(base, target):
    taken, out = set(), {}
    for t in target:
        for b in base:
            like = b["heading"].lower() == t["heading"].lower() or dice(b["heading_words"], t["heading_words"]) > lx.HEADING_SIMILARITY
            if t["number"] and b["number"] == t["number"] and like and b["i"] not in taken:
                out[t["i"]] = (b["i"], True)
                taken.add(b["i"])
                break
    for t in target:
        free = [b for b in base if b["i"] not in taken] if t["i"] not in out else []
        best = max(free, key=lambda b: (dice(b["words"], t["words"]), -b["i"]), default=None)
        if best and dice(best["words"], t["words"]) >= lx.TEXT_SIMILARITY:
            out[t["i"]] = (best["i"], False)
            taken.add(best["i"])
    return {(t, b, n) for t, (b, n) in out.items()}


def side(pick, pair, name):
    rows = []
    for i in range(pick.randrange(0, 9)):
        words = sorted(set(pick.choices([f"{'w' * (k % 7 + 1)}{k}" for k in range(14)], k=pick.randrange(0, 9))))
        heads = sorted(set(pick.choices(["fees", "term", "notice", "law"], k=pick.randrange(0, 3))))
        rows.append({
            "pair_id": pair, "side": name, "i": i, "number": pick.choice(["", "1", "2", "3"]), "heading": " ".join(heads),
            "full_text": " ".join(words), "words": words, "heading_words": heads,
        })
    return rows


def test_alignment_equals_all_pairs(spark):
    pick = random.Random(4)
    sides = {f"p{n}": (side(pick, f"p{n}", "base"), side(pick, f"p{n}", "target")) for n in range(60)}
    clauses = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for b, t in sides.values() for r in (*b, *t)], SCHEMA)
    got = compare.align_clauses(clauses).collect()
    for pair, (base, target) in sides.items():
        assert {(r["t"], r["b"], r["by_number"]) for r in got if r["pair_id"] == pair} == greedy(base, target)


def test_leading_words_keep_every_like_pair(spark):
    pick = random.Random(9)
    sets = [sorted(set(pick.choices([f"{'x' * (k % 5)}{k}" for k in range(12)], k=pick.randrange(0, 12)))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(sets)), "id int, words array<string>")
    leads = {r["id"]: set(r["l"]) for r in rows.select("id", compare._leading_words(rows["words"], lx.TEXT_SIMILARITY).alias("l")).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if dice(a, b) >= lx.TEXT_SIMILARITY:
                assert leads[i] & leads[j]


def test_numbers_settle_before_texts_are_searched(spark, monkeypatch):
    heads = [("1", "fees"), ("2", "term"), ("", "notice")]
    rows = [("p", s, i, n, h, h, ["alpha", "beta", h], [h]) for s in ("base", "target") for i, (n, h) in enumerate(heads)]
    seen = []
    search = compare.text_candidates
    monkeypatch.setattr(compare, "text_candidates", lambda b, t: seen.append((b, t)) or search(b, t))
    got = compare.align_clauses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["t"], r["b"], r["by_number"]) for r in got} == {(0, 0, True), (1, 1, True), (2, 2, False)}
    assert [[r[0] for r in x.select(n).collect()] for x, n in zip(seen[0], "bt", strict=True)] == [[2], [2]]
