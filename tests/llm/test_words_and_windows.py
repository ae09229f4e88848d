"""Spelling variants, order-preserving packing and the divergence audit against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import source_divergence, spelling, window_packing
from skyledger.llm.queries import QUERIES

from .plain import LOWER

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return rows


@pytest.fixture(scope="module")
def word_counts():
    rng = random.Random(3)
    counts = {"": 5, "a": 3, "aa": 30, "aaa": 300, "aaaa": 3000, "b": 3, "ab": 7, "éa": 90, "é": 9, "中文": 4, "中": 400, "😀a": 2, "😀": 50, "aaaaab": 1, "aaaaba": 20}
    for _ in range(150):
        counts["".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))] = rng.choice([1, 2, 5, 20, 300, 4000])
    return counts


@pytest.mark.parametrize("ratio", [2, 10])
def test_variants(spark, word_counts, ratio):
    words = spark.createDataFrame([*word_counts.items(), (None, 8)], "word string, n int").repartition(3)
    got = spelling.variants(words, ratio)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len(rows) == len(word_counts)
    expected = plain_variants({w: n for w, n in word_counts.items() if w}, ratio) | {("", None, "", 5, 0, None)}
    assert {tuple(r) for r in rows} == expected


def test_neighbours_are_found_once(spark, word_counts):
    rows = spelling.neighbours(spark.createDataFrame(list(word_counts.items()), "word string, n long")).collect()
    expected = {(a, b, word_counts[b]) for a in word_counts for b in word_counts if a and b and one_edit(a, b)}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_words_with_the_terminator_and_no_words(spark):
    rows = spelling.variants(spark.createDataFrame([("a\0b", 1), ("a\0c", 50), ("ab", 7)], "word string, n long")).collect()
    assert all(r["n_near"] == 0 and r["root"] == r["word"] for r in rows) and len(rows) == 3
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), 1)


def test_letter_runs(edge, edge_rows, empty):
    got = Counter((r["key"], r["run"]) for r in spelling.letter_runs(edge, min_length=4).collect())
    expected = Counter((k, run.translate(LOWER)) for k, t, *_ in edge_rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(run) >= 4)
    assert got == expected and any("ö" in run for _, run in got) and any("Ü" in run for _, run in got)
    counted = spelling.counted_words(spelling.letter_runs(edge).withColumnRenamed("run", "word"), min_length=5, min_count=3)
    plain = Counter(run.translate(LOWER) for _, t, *_ in edge_rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert {tuple(r) for r in counted.collect()} == {(w, n) for w, n in plain.items() if len(w) >= 5 and n >= 3}
    assert spelling.letter_runs(empty).count() == 0


def test_spelling_query(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    kept = {w: n for w, n in counts.items() if n >= 2}
    rows = {r["word"]: r for r in QUERIES["op11_spelling_variants"](spark, sf_dir).collect()}
    assert {w: r["n"] for w, r in rows.items()} == kept
    by_gap = defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1 :], i].add(w)
    near = defaultdict(set)
    for (short, _), group in by_gap.items():
        for a, b in combinations(group, 2):
            near[a].add(b), near[b].add(a)
        if short in kept:
            for w in group:
                near[w].add(short), near[short].add(w)
    assert all(r["n_near"] == len(near[w]) for w, r in rows.items())
    assert any(r["form"] for r in rows.values())


def least_cost(places, fines, width, each):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= width:
                cost = best[i] + (0 if n & (n - 1) == 0 else width - n) + fines[j] + each
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best[-1]


def test_windows_cost_least():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.choice([5, 16, 37, 64])
        places = [0]
        for _ in range(rng.randint(1, 50)):
            places.append(places[-1] + rng.randint(1, width if rng.random() < 0.2 else min(6, width)))
        fines = [0] + [rng.choice([0, 3, 10]) for _ in places[1:]]
        cost, before = 0, 0
        for j in window_packing.window_cuts(places, fines, width, 1):
            n = places[j] - places[before]
            assert 0 < n <= width
            cost += (0 if n & (n - 1) == 0 else width - n) + fines[j] + 1
            before = j
        assert places[before] == places[-1] and cost == least_cost(places, fines, width, 1)


@pytest.mark.parametrize(("width", "block"), [(256, 1 << 20), (256, 1000), (7, 50), (1, 40)])
def test_windows_hold_every_id_once_and_in_order(edge, edge_rows, monkeypatch, width, block):
    monkeypatch.setattr(window_packing, "BLOCK_IDS", block)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = window_packing.pack_in_order(edge, VOCABULARY, width=width, order=["doc_id", "text"], with_ids=True).collect()
    ids = sorted(((k is not None, k or 0, t is not None, t or ""), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for k, t, *_ in edge_rows)
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    assert [i for r in rows for i in r["ids"]] == [i for _, doc in ids for i in doc]  # ranges are numbered in order
    at, sequence, doc = 0, None, iter(ids)
    left = 0
    for r in rows:
        if left == 0:
            key, current = next(doc)
            left = len(current)
        assert r["key"] == (key[1] if key[0] else None) and r["doc_tokens"] == len(current)
        assert r["start"] == len(current) - left and r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at = at if r["sequence_id"] == sequence else 0
        sequence = r["sequence_id"]
        assert r["offset"] == at
        at += r["length"]
        left -= r["length"]
        assert at <= width
    assert left == 0 and next(doc, None) is None


def test_windows_of_no_documents(spark, empty):
    assert window_packing.pack_in_order(empty, VOCABULARY).count() == 0
    only = window_packing.pack_in_order(spark.createDataFrame([(None, None)], "doc_id long, text string"), VOCABULARY).collect()
    assert [tuple(r)[:5] for r in only] == [(None, 0, 1, zlib.crc32(b"\2\0\0\0"), 1)]


def test_windows_are_little_padded_and_cut_at_sentences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = window_packing.pack_in_order(docs, VOCABULARY, with_ids=True).cache()
    assert {"Exchange"} & set(re.findall(r"\w+", window_packing.pack_in_order(docs, VOCABULARY)._jdf.queryExecution().executedPlan().toString())) == set()
    sizes = [r[1] for r in pieces.groupBy("sequence_id").agg(F.sum("length")).collect()]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padding <= 0.01 * sum(sizes)
    ends = window_packing.sentence_end_ids(Tokenizer.from_file(VOCABULARY).get_vocab())
    cut = [r for r in pieces.collect() if r["start"] + r["length"] < r["doc_tokens"]]
    assert sum(ends[r["ids"][-1]] for r in cut) >= 0.8 * len(cut)


def plain_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER))) for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for (la, source, _), found in zip(rows, terms, strict=True):
            if la == lang:
                docs.update(set(found))
                groups[source].update(found)
        kept = [t for t, n in docs.items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            best = sorted((-differ(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", best)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def audit_rows(rng, n):
    words = ["the", "The", "été", "中文", "x1y", "don't", *("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60))]
    rows = [(rng.choice(["en", "en", "de", None, ""]), rng.choice([None, "s1", "s2", "S2", "é", *(f"h{i}" for i in range(8))]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("fr", "only", "rare words here"), ("it", None, None), ("it", "s1", ""), ("en", "empty", None), rows[0], rows[0], ("en", "hot", "the " * 3000)]


@pytest.mark.parametrize(("block", "sources", "chunk", "step"), [(300_000, 128, 200_000, 1 << 19), (50, 3, 40, 7)])
def test_audit(spark, monkeypatch, block, sources, chunk, step):
    for name, value in (("BLOCK_SOURCES", sources), ("CHUNK_POSTINGS", chunk), ("STEP_PAIRS", step), ("SHARD_POSTINGS", 400)):
        monkeypatch.setattr(source_divergence, name, value)
    monkeypatch.setattr(source_divergence.frequencies, "__defaults__", (*source_divergence.frequencies.__defaults__[:-1], block))
    rows = audit_rows(random.Random(8), 150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    got = source_divergence.audit(docs, min_documents=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows_out = [tuple(r) for r in got.collect()]
    expected = plain_audit(rows, 4, 3)
    assert len(rows_out) == len(expected) and set(rows_out) == expected


def test_frequencies(spark, edge, edge_rows, empty):
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in source_divergence.frequencies(edge, block=100).collect()}
    n, docs = Counter(), Counter()
    for _, t, lang, source, *_ in edge_rows:
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER)))
        for term, times in found.items():
            n[lang or "", source or "", term] += times
            docs[lang or "", source or "", term] += 1
    assert got == {k: (n[k], docs[k]) for k in n}
    assert source_divergence.frequencies(empty).count() == 0 and source_divergence.audit(empty).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 10**15, 7)], "n long, total long, terms long").select(source_divergence._share("n", "total", "terms").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 2) // (10**15 + 14)
