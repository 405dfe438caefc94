"""Operators 11-13 against brute-force versions: licence scans, spelling variants, manifests."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlake.llm import license_scan, merkle, spelling

SF = "/root/testdata/sf0.001"

# --- licence scans ------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words11(text):
    return WORD.findall((text or "").translate(UPPER_TO_LOWER))


def brute_license(text, K=license_scan.K, gap=license_scan.DIAGONAL_GAP,
                  least=license_scan.MIN_COVERAGE):
    w = words11(text)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        s = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += s
        if s:
            base.add(label)
    found, score = set(), 0.0
    for label, template in license_scan.TEMPLATES:
        tw = words11(template)
        n_grams = len(tw) - K + 1
        at = {}
        for j in range(n_grams):
            at.setdefault(tuple(tw[j:j + K]), []).append(j)
        votes = [(i - j, i, j) for i in range(len(w) - K + 1) for j in at.get(tuple(w[i:i + K]), [])]
        if not votes:
            continue
        diagonals = sorted({v[0] for v in votes})
        groups, current = [], [diagonals[0]]
        for d in diagonals[1:]:
            if d - current[-1] <= gap:
                current.append(d)
            else:
                groups.append(current)
                current = [d]
        groups.append(current)
        for group in groups:
            inside = [v for v in votes if v[0] in set(group)]
            coverage = len({v[2] for v in inside}) / n_grams
            span = max(v[1] for v in inside) + K - min(v[1] for v in inside)
            score = max(score, coverage)
            if coverage >= least and span <= 2 * (n_grams + K - 1):
                found.add(label)
    return (len(w), len(starts), min(starts) if starts else None, max(starts) if starts else None,
            ",".join(sorted(base)), ",".join(sorted(base | found)), score)


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
       'software and associated documentation files (the "Software"), to deal in the Software '
       "without restriction, including without limitation the rights to use, copy, modify, merge, "
       "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
       "to whom the Software is furnished to do so.")


def licence_rows():
    return [
        (1, "Released under the MIT License.\nMore text here."),
        (2, "Some words. " + MIT.replace("merge, ", "merge, rework, ").replace("free of", "free, of")),
        (3, "This work is licensed under the GNU General Public License, version 3. Also CC BY."),
        (4, None), (5, ""), (6, "cc by cc by cc by MIT license"),
        (7, "Licensed under the Apache License, Version 2.0. " * 3),
        (8, "licensed under cc by-nc 4.0 and licensed under CC BY-SA 4.0"),
        (9, "GNU GENERAL PUBLIC LICENSE gnu general public licence"),
        (10, " ".join(MIT.split()[:12])),
        (None, "apache license"), (11, "ÄPACHE LICENSE mit license mit\tlicense"),
    ]


def test_licences_by_brute_force(spark):
    rows = licence_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute_license(r[1]) for r in rows}
    for r in got:
        g = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert g == want[r.doc_id][:6], r.doc_id
        assert r.score == pytest.approx(want[r.doc_id][6])
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].labels == "mit" and by_id[2].found == "mit" and by_id[2].n_base == 0
    assert by_id[7].n_base == 3 and by_id[7].labels == "apache,apache-2.0"
    assert by_id[10].found == "" and 0 < by_id[10].score < license_scan.MIN_COVERAGE
    assert by_id[4].n_words == 0 and by_id[4].first_word is None and by_id[4].score == 0


def test_licences_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_license(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6]
        assert r.score == pytest.approx(want[6])


# --- spelling variants --------------------------------------------------------------------

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER_TO_LOWER)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    cut = h % len(run)
                    run = run[:cut] + run[cut + 1:]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w in vocab:
        best = min(near[w], key=lambda v: (-vocab[v], v)) if near[w] else None
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None
    out = {}
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def test_sorted_scan_finds_every_pair():
    import random
    rng = random.Random(7)
    letters = "abcdeé"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 8)))
                    for _ in range(400)})
    got = set(spelling.near_in_sorted(words))
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert got == want and want


def test_variants_by_brute_force(spark):
    base = ["colour", "colour", "color", "colors", "colours", "flavour", "flavor", "flavours"]
    rows = [(i, " ".join(base * (1 + i % 3)) + " Colour COLOUR Zzzzz zzzzzz") for i in range(12)]
    rows += [(None, "colour colour"), (99, None), (100, ""), (12, "Ünïcödé ünïcödé ünicödé " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
           for r in spelling.variants(docs).collect()}
    assert got == brute_variants(rows)
    assert got["color"][0] == "colour"


def test_variants_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = spelling.variants(docs).collect()
    want = brute_variants(rows)
    assert len(got) == len(want)
    assert all(want[r.word] == (r.form, r.root, r.n, r.n_near, r.form_n) for r in got)
    assert any(r.form for r in got)


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []


# --- manifests ----------------------------------------------------------------------------

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    t = str(v)
    return f"{len(t.encode())}:{t}"


def leaf(r, text):
    return H("".join(field(x) for x in (r[0], r[1], r[2], r[3], text)))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i:i + 3])) for i in range(0, len(cur), 3)])

    def path(i):
        out = []
        for lv in levels[:-1]:
            start = i // 3 * 3
            run, at = lv[start:start + 3], i - start
            out.append(("".join(run[:at]), "".join(run[at + 1:])))
            i //= 3
        return out
    return levels[-1][0], path


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    tops = {}
    for source, members in groups.items():
        members = sorted(members, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, path = tree([leaf(r, r[4]) for r in members])
        tops[source] = (top, path, members)
    order = sorted(tops, key=lambda s: (0, b"") if s is None else (1, s.encode()))
    root, top_path = tree([tops[s][0] for s in order])
    out = []
    for at, source in enumerate(order):
        top, path, members = tops[source]
        for i, r in enumerate(members):
            full = path(i) + top_path(at)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in full:
                folded = H(left + folded + right)
            out.append((r[0], leaf(r, r[4]), top, root, H("".join(a + b for a, b in full)),
                        folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(docs):
    got = merkle.manifest(docs).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root,
                    r.verified) for r in got), key=repr)


def test_manifest_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    got = manifest_rows(docs)
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_shapes(spark, n):
    rows = [(i, "s" if i % 4 else None, "en", 5, f"a\nb {i}") for i in range(n)]
    rows += [(3, "s", "en", 5, "a\nb 3")]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, "
                                       "text string")
    assert manifest_rows(docs) == brute_manifest(rows)


def test_manifest_odd_rows(spark):
    rows = [(None, None, None, None, None), (5, "ä", "de", 2, "x\ny"), (2, "a", None, 0, ""),
            (7, "a", "en", None, "\n\n"), (7, "a", "en", None, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, "
                                       "text string").withColumn("g", F.lit("clash"))
    assert manifest_rows(docs) == brute_manifest(rows)
    assert merkle.manifest(docs.where("false")).collect() == []


def test_postorder_positions(spark):
    """Closed-form positions agree with a postorder walk of every node."""
    for n in (1, 2, 3, 4, 5, 13, 27, 31):
        levels, sizes = [], n
        while True:
            levels.append(sizes)
            if sizes == 1:
                break
            sizes = (sizes + 2) // 3
        top = len(levels) - 1
        order = []

        def walk(level, k):
            if level > 0:
                for child in range(3 * k, min(3 * k + 3, levels[level - 1])):
                    walk(level - 1, child)
            order.append((level, k))
        walk(top, 0)
        frame = spark.createDataFrame([(lv, k, n, top) for lv, k in order],
                                      "level int, k long, n long, top int")
        got = frame.select(merkle.postorder("level", "k", "n", "top").alias("p")).collect()
        assert [r.p for r in got] == list(range(len(order)))


def test_pipeline_keeps_one_document_of_each_simhash_group(spark):
    import corpus_pipeline
    from wardlake.llm import queries, simhash

    docs = queries.documents(spark, SF)
    groups = simhash.near_duplicates(docs, width=3, distance=2).collect()
    want = sorted({r.component_id for r in groups})
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == want and len(want) < docs.count()


def test_language_needs_a_letter(spark):
    from wardlake.llm import langid

    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")],
                                  "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(5, "½ ² ³ ① 12"), (6, None), (7, "ÿ"), (8, "the dog")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(train)).collect()}
    assert got[5] == "und" and got[6] == "und" and got[7] != "und" and got[8] == "en"
