"""n-gram join, line deduplication, spot signatures, license scan against brute force."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from lexfolio.llm import licenses, line_dedup, ngram_join, spotsigs
from tests.llm.conftest import prose


def _set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(texts):
    sets = {i: _set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _near_texts():
    base = prose(1, 120).split()
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (6, prose(9, 5000))]
    rows += [(10 + k, " ".join(base)) for k in range(6)]
    for k in range(12):  # near copies, some of which are only linked through others
        edited = list(base)
        for j in range(k % 4 + 1):
            edited[(k * 17 + j * 29) % 120] = f"new{k}_{j}"
        rows.append((30 + k, " ".join(edited)))
    chain = prose(2, 60).split()
    for k in range(6):
        rows.append((60 + k, " ".join(chain[3 * k :] + prose(100 + k, 3 * k).split())))
    shared = prose(3, 60)
    rows += [(80 + k, f"{prose(200 + k, 14)} {shared}") for k in range(8)]
    rows += [(100 + k, f"{prose(300 + k, 40)} {shared}") for k in range(8)]
    return rows


def test_ngram_join_matches_brute_force(docs_frame):
    rows = _near_texts()
    got = ngram_join.near_duplicates(docs_frame([(i, t, "en") for i, t in rows] + [(None, "one two", "en")]))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _components(rows)


def _one_group(first_id, seed):
    """Texts of one prefix and size: the first is too far from the others, which are alike; fillers make the ends frequent."""
    head, ends = prose(seed, 12).split(), [["la", "lb"], ["xa", "xb"], ["xa", "xc"], ["xa", "xd"], ["za", "zb"]]
    ends = [[f"{w}{seed}" for w in end] for end in ends]
    rows = [(first_id + k, " ".join(head + end)) for k, end in enumerate(ends)]
    fill = [f"{prose(seed + 50 * (k + 1) + j, 20)} {' '.join(head[-4:] + end)}" for k, end in enumerate(ends) for j in range(7)]
    return rows, [(first_id + 100 + k, t) for k, t in enumerate(fill)]


def test_ngram_join_links_members_of_a_group_that_no_other_group_meets(docs_frame):
    rows, fill = _one_group(1000, 21)
    more, more_fill = _one_group(3000, 22)
    every = rows + fill + more + more_fill
    want = _components(every)
    assert [want[1000 + k][1] for k in range(5)] == [1000, 1001, 1001, 1001, 1004]
    # the members are one group, and no other text holds its prefix
    counts = ngram_join.bucket_counts(frame := docs_frame([(i, t, "en") for i, t in every]), 5)
    found = {r.doc_id: r for r in ngram_join.prefixes(frame, counts, 5, 75).collect()}
    assert {found[1000 + k].prefix_key for k in range(5)} == {found[1000].prefix_key}
    assert not any(set(found[1000].prefix) & set(found[i].prefix) for i, _ in fill)
    got = ngram_join.near_duplicates(frame)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_ngram_join_of_repeated_rows_and_empty_table(docs_frame):
    text = prose(5, 30)
    got = ngram_join.near_duplicates(docs_frame([(1, text, "en"), (1, text, "en"), (2, text, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1)]
    assert ngram_join.near_duplicates(docs_frame([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.doc_id: r.component_id for r in ngram_join.components(edges).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def _near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def _deduped(rows):
    """Texts by (id, text) under brute force; rows of one id whose texts differ need an order of their own."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (i, k))
    gone = {a for a in first if any(first[b] < first[a] and _near(a, b) for b in first)}
    out = {}
    for i, t in rows:
        if i is None or t is None:
            out[i] = t
            continue
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (x.strip(" ") not in gone and first[x.strip(" ")] == (i, k)))
    return out


def test_line_dedup_matches_brute_force(docs_frame):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [
        (1, f"{line}\nshort\n\nshort\n{prose(1, 12)}"), (2, f"  {line} \nThe quick brown fox jumps over the lazy dog\nown words of two"),
        (3, f"{line}s\n{line[1:]}\n{line[:20]}{line[21:]}\nx{line}"), (4, None), (5, ""), (6, "\n\n"), (7, f"{line}!!\nshort\nshorf"),
        (8, prose(2, 3000)), (9, prose(2, 3000) + "x"), (10, "ab" * 12), (11, "ba" * 12), (12, "ab" * 11 + "a"), (None, line),
    ]
    got = line_dedup.dedupe(docs_frame([(i, t, "en") for i, t in rows]))
    assert {r.doc_id: r.text for r in got.collect()} == _deduped(rows)
    assert "score" in got.columns and got.filter("n_removed > n_lines").count() == 0
    assert line_dedup.dedupe(docs_frame([])).count() == 0


def test_short_lines_are_near_as_well(docs_frame):
    rows = [(1, "Subscribe to us now\nab\nx"), (2, "Subscribe to us now!\nabc\ny"), (3, "cd\nto us\nq\r"), (4, "tous\n2024\n2025"), (5, "bc\n\u00e9\u00e8"), (6, "z\n\n20245")]
    got = line_dedup.dedupe(docs_frame([(i, t, "en") for i, t in rows]))
    assert {r.doc_id: r.text for r in got.collect()} == _deduped(rows)


def test_rows_that_share_an_id_lose_only_their_own_lines(docs_frame):
    rows = [(0, "bar", "en"), (1, "foo is only here", "en"), (1, "bar", "en"), (2, "said twice", "en"), (2, "said twice", "en"), (3, "said twice", "en")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedupe(docs_frame(rows)).collect())
    assert got == [(0, "bar", 0), (1, "", 1), (1, "foo is only here", 0), (2, "said twice", 0), (2, "said twice", 0), (3, "", 1)]


def test_a_bound_beyond_one_edit_is_refused(docs_frame):
    with pytest.raises(ValueError, match="edits"):
        line_dedup.dedupe(docs_frame([]), edits=2)


def test_fingerprints_against_the_next_document(docs_frame):
    rows = [(5, "the cat sat on the warm mat by the old door"), (3, "the cat sat on the warm mat by the old door"), (9, None), (7, ""), (8, "the of and " * 500), (1, prose(4, 50) + " € 𝄞")]
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs_frame([(i, t, "en") for i, t in rows] + [(None, "x", "en")])).collect()}
    ordered = sorted(rows)
    assert set(got) == {i for i, _ in rows}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[3].fingerprint and got[3].near_next == 1.0
    assert got[9].fingerprint == got[7].fingerprint == ""
    alone = spotsigs.fingerprints(docs_frame([(4, "the cat sat", None)])).first()
    assert alone.near_next == 1.0
    assert spotsigs.fingerprints(docs_frame([])).count() == 0


def test_spots_are_chains_behind_anchors(docs_frame):
    text = "The cat of a red house is the best"
    count = docs_frame([(1, text, "en")]).select(F.size(spotsigs.spots(F.col("text"))).alias("n")).first().n
    assert count == 2  # the-cat-red, a-red-house; "is the best" has one content word


def test_near_pairs_match_brute_force(docs_frame):
    base = [f"the {w} and" for w in prose(6, 60).split()]
    rows = [(k, " ".join(base[: 60 - 3 * k] + [f"the new{k}_{j} and" for j in range(2 * k)])) for k in range(8)] + [(20, " ".join(base)), (21, None), (22, "")]
    frame = docs_frame([(i, t, "en") for i, t in rows])
    sets = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", spotsigs.spots(F.col("text")).alias("s")).collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    want = {(a, b) for a, b in itertools.combinations(sorted(least.values()), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75}
    assert want and {(r.a, r.b) for r in spotsigs.near_pairs(frame).collect()} == want


def test_license_scan(docs_frame):
    rows = [
        (1, "Some text.\nReleased under the MIT License."), (2, "under the\nmit, license; CC BY-NC 4.0 cc by nc cc by nc"), (3, None), (4, ""), (5, "...!!"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under the Apache License, Version 2.0."),
        (8, "a b c " * 20_000), (9, "Üñder THE mit license é"), (10, "permitlicense under the mit licenses"),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_frame([(i, t, "en") for i, t in rows] + [(None, "x", "")])).collect()}
    assert [got[i].base_labels for i in range(1, 11)] == ["mit", "cc-by-nc,mit", "", "", "", "", "apache-2", "", "", ""]
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (15, 4, 0, 12)
    assert (got[3].n_words, got[5].n_words, got[8].n_words, got[9].n_words) == (0, 0, 60_000, 5)
    assert got[6].labels == "gpl-3" and got[6].score == 1.0 and got[8].score == 0.0
    assert licenses.scan(docs_frame([])).count() == 0


def test_license_matches_are_exactly_the_contained_templates(docs_frame):
    lines = ["licensed under cc by sa 4 0", "0 4 sa by cc under licensed", "licensed under cc by 4 0", "gnu lesser general public license or any", "gnu general public license"]
    got = licenses.matches(docs_frame([(i, t, "en") for i, t in enumerate(lines)]), ["doc_id"]).collect()
    want = set()
    for i, t in enumerate(lines):
        for label, words in licenses.TEMPLATES:
            w = set(words.split())
            if len(w & set(t.split())) >= 0.9 * len(w):
                want.add((i, label))
    assert {(r.doc_id, r.label) for r in got} == want and want


def test_license_blocks_follow_the_text_and_not_its_lines(docs_frame):
    mit = "Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software\n * and associated documentation files"
    bsd = "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted"
    gap = prose(7, 40)
    rows = [
        (1, f"{gap}\n{mit} (the Software)"), (2, f"{bsd} provided that\n{gap}"), (3, f"{gap} {bsd} {gap}".replace("\n", " ")),
        (4, f"gnu {gap} lesser {gap} general {gap} public {gap} license"), (5, f"{'public license general ' * 4000} gnu lesser general public license"),
        (6, f"gnu lesser {gap} gnu, Lesser\n\nGeneral public (own) license"), (7, f"gnu lesser general {gap}\npublic license {gap}"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs_frame([(i, t, "en") for i, t in rows])).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["mit", "bsd", "bsd", "", "lgpl", "lgpl", ""]
    assert got[1][1] == got[2][1] == got[5][1] == 1.0 and got[4][1] == got[7][1] == 0.0


def test_parity_fields_never_exceed_the_difference():
    shingles = ngram_join.Shingles(5)
    sets = [shingles(t) for _, t in _near_texts()]
    for a, b in itertools.combinations(sets, 2):
        differing = sum(int(x).bit_count() for x in (ngram_join.parity(a) ^ ngram_join.parity(b)).view("u8"))
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))
