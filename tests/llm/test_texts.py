"""Word hashes, token ids and the operators built on them, against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import language_id, lm_scoring, ngram_jaccard, packing, token_output
from skyledger.llm.common import crc_mod, each_step
from skyledger.llm.tokens import Coder
from skyledger.session import scratch_path

from .plain import jaccard_groups, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain_ids():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_hashes_name_words(edge_rows):
    texts = [r[1] for r in edge_rows]
    names, seen = {}, {}
    for row, _, hashes, at in each_step(pa.array(texts, pa.string()), 5000):
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            expected = words(texts[row + i])
            assert b - a == len(expected)
            for h, w in zip(hashes[a:b].tolist(), expected, strict=True):
                assert names.setdefault(h, w) == w and seen.setdefault(w, h) == h


def test_word_hashes_of_sliced_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1)
    whole = [len(at) - 1 for _, _, _, at in each_step(column)]
    assert sum(whole) == 3 and sum(len(h) for _, _, h, _ in each_step(column)) == 4


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_coder_equals_the_library(edge_rows, name):
    path = public_tokenizers.path(name)
    texts = [r[1] for r in edge_rows] * 2
    tokenizer, got = Tokenizer.from_file(path), []
    for _, _, ids, at in Coder(path).encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_words_go_to_the_library_together():
    tool, asked = Coder(VOCABULARY), []
    lean = tool.lean

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return lean.encode_batch_fast(texts, **options)

    tool.lean = Counting()
    text = " ".join(f"{a}{b}\u00e9{c}" for a in "abcdefghij" for b in "klmnop" for c in "qrstuv")
    ((_, _, ids, _),) = tool.encode(pa.array([text]))
    assert ids.tolist() == tool.full.encode(text, add_special_tokens=False).ids
    assert len(tool.known) == 360 and len(asked) == 2


def test_blocks_with_long_rules_are_expanded_in_place(monkeypatch):
    rules = np.array([[5, 6], *([100 + i, 100 + i] for i in range(9))])  # rule 9 stands for 1,024 ids, all rules for 2,046
    lengths = token_output.rule_lengths(rules, 100)
    symbols = np.array([109, 3, 101])
    block = token_output.Block(100, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), 4)
    expected = [5, 6] * 512 + [3] + [5, 6] * 2
    expanded, expand = [], token_output.Block._expand
    monkeypatch.setattr(token_output.Block, "_expand", lambda self, x: expanded.append(len(x)) or expand(self, x))
    assert block.all().tolist() == expected
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 1000)
    assert block.all().tolist() == expected
    assert expanded == [len(rules), len(symbols)]


@pytest.mark.parametrize("rounds", [1, 3, 8])
def test_pair_grammars_are_reversible(rounds):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.int64), np.array([5]), np.full(5000, 7), np.tile(rng.integers(0, 90, 40), 300), rng.integers(0, 30, 20_000)):
        rules, symbols = token_output.compress(ids, 100, rounds, 4)
        lengths = token_output.rule_lengths(rules, 100)
        block = token_output.Block(100, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), 4)
        assert block.all().tolist() == ids.tolist()
        for _ in range(20):
            start = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, len(ids) - start + 1))
            assert block.span(start, n).tolist() == ids[start : start + n].tolist()
    assert len(symbols) < 20_000


def test_token_blocks(spark, edge, edge_rows, empty, plain_ids):
    path = scratch_path(spark, "blocks")
    token_output.write_token_blocks(edge, VOCABULARY, path, block_tokens=4000)
    got = sorted(((r["start"], r["key"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_token_blocks(spark, path).collect()))
    assert [r[1] for r in got] == sorted((r[0] for r in edge_rows), key=lambda k: (k is not None, k or 0))
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    expected = Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t, *_ in edge_rows for ids in [plain_ids(t) + [2]])
    assert Counter(r[1:] for r in got) == expected
    none = scratch_path(spark, "blocks")
    token_output.write_token_blocks(empty, VOCABULARY, none)
    assert token_output.read_token_blocks(spark, none).count() == 0


def test_packing(edge, edge_rows, empty, plain_ids, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    pieces = packing.token_pieces(edge, VOCABULARY, width=256, with_ids=True)
    packed = packing.pack(pieces, width=256).cache()
    rows = packed.collect()
    expected = Counter()
    for k, t, *_ in edge_rows:
        ids = plain_ids(t) + [0]
        for p in range(-(-len(ids) // 256)):
            part = ids[p * 256 : (p + 1) * 256]
            expected[k, p, p * 256, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["key"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 256 + 1
    for r in packing.sequences(packed).collect():
        assert r["ids"] == [i for x in sorted(bins[r["sequence_id"]], key=lambda x: x["offset"]) for i in x["ids"]]
    assert packing.pack(packing.token_pieces(empty, VOCABULARY)).count() == 0


def test_packing_of_columns_named_like_its_own(spark):
    items = spark.createDataFrame([(i, 30 + i % 50, "a", "b", 1) for i in range(60)], "__row int, length int, __bin string, __size string, __fill int")
    out = packing.pack(items, width=100)
    assert out.columns == [*items.columns, "sequence_id", "offset"]
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(tuple(r) for r in items.collect())


def test_packing_of_given_lengths(spark):
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate([60, 40, 50, 50, 30, 70, 0, None, 250, 100])], "id int, length int, offset string")
    rows = packing.pack(items, width=100).collect()
    assert len(rows) == 10 and len({r["sequence_id"] for r in rows if r["length"]}) <= 6
    assert len([r for r in rows if r["length"] == 250]) == 1


def test_language_id(edge, edge_rows, empty):
    model = language_id.train(edge.where(crc_mod(F.col("doc_id"), 5) != 0))
    assert model.languages == ["de", "en"]
    got = language_id.identify(edge, model)
    assert got.columns == [c for c in edge.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 <= r["score"] <= 1
            if len(r["text"].split()) > 8 and r["lang"]:
                assert r["lang_pred"] == r["lang"]
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(edge, nothing).collect()} == {"und"}


def plain_grams(text, buckets):
    """Bucket counts of the letter n-grams of a text, one at a time."""
    shift, counts = 32 - (buckets.bit_length() - 1), Counter()
    letter = lambda c: 97 <= c <= 122 or (c >= 0xC0 and c not in (0xD7, 0xF7) and not 0x2000 <= c < 0x2C00 and not 0x3000 <= c < 0x3040)
    points = [c if letter(c) else 32 for c in map(ord, text.lower())]
    for n in language_id.NGRAMS:
        for i in range(len(points) - n + 1):
            gram = points[i : i + n]
            if any(c != 32 for c in gram):
                h = 0
                for k, c in enumerate(gram, 1):
                    h = (h * 0x01000193 + c * 0x85EBCA6B + k) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                counts[(((h ^ (h >> 12)) * 0x297A2D39) & 0xFFFFFFFF) >> shift] += 1
    return counts


def test_language_id_is_naive_bayes(edge, edge_rows):
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    texts = [r[1] for r in rows]
    model = language_id.train(edge.where(F.length("text") < 5000))
    languages = sorted({r[2] for r in rows if r[1] is not None and r[2]})
    assert model.languages == languages
    prior = Counter(r[2] for r in rows if r[1] is not None and r[2])
    tables = {lang: sum((plain_grams(t, model.buckets) for t in {r[1] for r in rows if r[2] == lang and r[1] is not None}), Counter()) for lang in languages}
    got = Counter((r["text"], r["lang_pred"], round(r["score"], 3)) for r in language_id.identify(edge.where("length(text) < 5000 OR text IS NULL"), model, keep=["text"]).collect())
    expected = Counter()
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            expected[text, "und", 0.0] += 1
            continue
        grams, logs = plain_grams(text, model.buckets), {}
        for lang in languages:
            total = tables[lang].total() + 0.5 * model.buckets
            logs[lang] = math.log(prior[lang] / prior.total()) + sum(n * math.log((tables[lang][g] + 0.5) / total) for g, n in grams.items())
        best = max(languages, key=lambda x: logs[x])
        expected[text, best, round(1 / sum(math.exp(v - logs[best]) for v in logs.values()), 3)] += 1
    assert got == expected


def test_copies_teach_a_language_once(spark):
    """The sample is bounded in different texts; a text that is a third of all rows neither floods it nor falls out of it."""
    rows = [("ab " * 5 + str(i), "a") for i in range(30)] + [("xyz only text", "b")] * 200 + [("copy of a", "a")] * 100
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    model = language_id.train(docs, docs_per_language=10)
    assert model.languages == ["a", "b"]
    single = language_id.train(docs.dropDuplicates(), docs_per_language=10)
    assert np.array_equal(model.weights, single.weights)


def test_language_id_on_held_out_documents(spark, sf_dir):
    from skyledger.llm.queries import QUERIES

    rows = QUERIES["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_lm_scores(edge, edge_rows, empty, monkeypatch):
    held = crc_mod(F.col("doc_id"), 7) == 2
    # A small table of frequent words, so that the join has work.
    monkeypatch.setattr(lm_scoring, "MAX_FREQUENT", 20)
    model = lm_scoring.fit(edge.where(~held))
    rows = lm_scoring.score(edge, model).collect()
    counts = Counter()
    for k, t, *_ in edge_rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            counts.update([*words(t), None])
    total = sum(counts.values())
    assert (model.tokens, model.words) == (total, len(counts))
    expected = Counter()
    for k, t, *_ in edge_rows:
        tokens = [*words(t), None]
        expected[k, len(tokens), sum(w in counts for w in tokens), round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens), 6)] += 1
    assert Counter((r["key"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows) and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm_scoring.score(empty, model).count() == 0
    blank = lm_scoring.fit(empty)
    assert {(r["n_known"], r["score"] <= 0) for r in lm_scoring.score(edge, blank).collect()} == {(0, True)}


def test_lm_scores_by_a_filter_too_large_to_broadcast(edge, edge_rows, monkeypatch):
    """Scores don't depend on whether the filter is broadcast or met in its segments, and no n-gram is left out of it."""
    monkeypatch.setattr(lm_scoring, "SEGMENT_TOKENS", 1000)
    monkeypatch.setattr(lm_scoring, "ASK_BYTES", 20_000)
    held = crc_mod(F.col("doc_id"), 7) == 2
    found = []
    for most in (1 << 30, 1 << 10):
        monkeypatch.setattr(lm_scoring, "MAX_FILTER_BITS", most)
        model = lm_scoring.fit(edge.where(~held))
        entries = model.segments.agg(F.sum("entries")).first()[0]
        found.append((entries, model.weights.tolist(), Counter((r["key"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scoring.score(edge, model).collect())))
        assert (model.filter is None) == (most < 1 << 30)
    assert found[0] == found[1]
    grams = Counter()
    for k, t, *_ in edge_rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            tokens = [*words(t), None]
            grams.update([*((w,) for w in tokens), *zip([None, *tokens], tokens, strict=False)])
    assert found[0][0] == lm_scoring.level_of(np.array(list(grams.values()))).sum()


def test_lm_scores_are_those_of_the_counts(edge, edge_rows):
    """Levels from plain counts, the formula in plain Python; the filter only ever overstates, and rarely."""
    held = crc_mod(F.col("doc_id"), 7) == 2
    model, scored = lm_scoring.learn_and_score(edge, ~held)
    measured = lm_scoring.measure(edge, model, learned=~held)
    grams = Counter()
    for k, t, *_ in edge_rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            tokens = [*words(t), None]
            grams.update([*((w,) for w in tokens), *zip([None, *tokens], tokens, strict=False)])
    level = lambda gram: int(lm_scoring.level_of(np.array([grams[gram]]))[0])
    texts = {}
    for k, t, *_ in edge_rows:
        texts.setdefault((k, len(words(t)) + 1), []).append(t)
    same = total = 0
    expected = Counter()
    for r in measured.collect():
        own, pair, learned = list(r["own"]), list(r["pair"]), float(r["key"]["learned"])
        logs = 0.0
        for i, (a, b) in enumerate(zip(own, pair, strict=True)):
            before = own[i - 1] if i else own[-1]
            count, both, first = (max(lm_scoring.VALUES[x] - learned, 0.0) for x in (a, b, before))
            single = (count + 1) / (model.tokens + model.words + 1)
            weight = model.weights[before]
            logs += math.log10(weight * both / max(first, both, 1.0) + (1 - weight) * single)
        expected[r["key"]["of"], len(own), round(logs, 6)] += 1
        candidates = [[*words(t), None] for t in texts[r["key"]["of"], len(own)]]
        exact = [([level((w,)) for w in c], [level(g) for g in zip([None, *c], c, strict=False)]) for c in candidates]
        a, b = min(exact, key=lambda e: sum(abs(x - y) for x, y in zip(own + pair, e[0] + e[1], strict=True)))
        assert all(x >= y for x, y in zip(own + pair, a + b, strict=True))
        same, total = same + sum(x == y for x, y in zip(own + pair, a + b, strict=True)), total + 2 * len(own)
    assert same >= 0.97 * total
    assert Counter((r["key"], r["n_tokens"], round(r["score"], 6)) for r in scored.collect()) == expected


def test_repeated_texts_score_apart(spark):
    """A learned text's own tokens do not speak for it: a text that occurs twice scores above one that occurs once."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 80))
    twice, once = [text() for _ in range(40)], [text() for _ in range(160)]
    rows = [(i, t) for i, t in enumerate(twice * 2 + once)]
    _, scored = lm_scoring.learn_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    each = {r["key"]: r["score"] / r["n_tokens"] for r in scored.collect()}
    assert min(each[i] for i in range(80)) > max(each[i] for i in range(80, 240))


def test_probabilities_about_sum_to_one(spark):
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{x}" for x in (rng.integers(0, 30, 200) ** 2 // 30).tolist())) for i in range(30)]
    model = lm_scoring.fit(spark.createDataFrame(texts, "doc_id long, text string"))
    vocabulary = sorted({w for _, t in texts for w in t.split()})
    for first in vocabulary[:6]:
        probe = spark.createDataFrame([(f"{first} {w}",) for w in vocabulary] + [(first,)], "text string").select(F.monotonically_increasing_id().alias("doc_id"), "text")
        rows = lm_scoring.measure(probe, model).collect()
        total = 0.0
        for r in rows:
            own, pair = list(r["own"]), list(r["pair"])
            i = 1  # the token after ``first``, an end for the last probe
            weight = model.weights[own[0]]
            total += weight * lm_scoring.VALUES[pair[i]] / max(lm_scoring.VALUES[own[0]], lm_scoring.VALUES[pair[i]], 1.0) + (1 - weight) * (lm_scoring.VALUES[own[i]] + 1) / (model.tokens + model.words + 1)
        assert 0.75 <= total <= 1.25


def test_mixing_weights_of_few_long_texts(spark):
    """All training texts choose the weights; levels that none of them has take the nearest level's."""
    rng = np.random.default_rng(4)
    follows = rng.integers(0, 400, 400)
    texts = []
    for i in range(3):
        word, out = i, []
        for _ in range(100_000):
            word = int(follows[word]) if rng.random() < 0.7 else int(rng.integers(0, 400))
            out.append(f"w{word}")
        texts.append((i, " ".join(out)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm_scoring.fit(docs)
    counts = Counter(w for _, t in texts for w in t.split())
    seen = set(lm_scoring.level_of(np.array(list(counts.values()))).tolist())
    assert len(model.weights) == len(lm_scoring.VALUES)
    assert all(model.weights[q] >= 0.5 for q in seen)
    assert model.weights[max(seen) + 1 :].min() == model.weights[max(seen)]
    assert lm_scoring.fit(docs.where("false")).weights.tolist() == [0.0] * len(lm_scoring.VALUES)


def test_filter_never_understates_levels():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    counts = rng.geometric(0.2, len(grams)) ** 3
    batch = lm_scoring._packed(grams, counts, 3)
    parts = [lm_scoring._build(pa.Table.from_batches([batch.slice(i, 1)]), 1, 3) for i in range(batch.num_rows)]
    fields = [np.frombuffer(p.column("field")[0].as_py(), np.uint8) for p in parts]
    sizes = np.array([len(f) for f in fields])
    built = lm_scoring.Filter(3, sizes * 8 // 512, np.cumsum(sizes) - sizes, np.concatenate(fields))
    levels = built.levels(grams)
    assert (levels >= lm_scoring.level_of(counts)).all() and (levels == lm_scoring.level_of(counts)).mean() > 0.9
    assert (built.levels(grams ^ np.uint64(1 << 30)) == 0).mean() > 0.9


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100), (1, 50, 100)])
def test_jaccard_groups(edge, edge_rows, n, num, den):
    rows = ngram_jaccard.join_groups(edge, n=n, num=num, den=den).collect()
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in rows} == jaccard_groups([r[:2] for r in edge_rows], n, num, den)
    assert len(rows) == len({r[0] for r in edge_rows})


def test_jaccard_groups_of_many_near_copies(spark, monkeypatch):
    """Near copies of one text that link with it but not with each other, in groups larger than a block."""
    import random

    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in ngram_jaccard.join_groups(frame).collect()}
    assert got == jaccard_groups(rows, 3, 90, 100)
    some = [r for r in rows if r[1] != " ".join(base)]
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in ngram_jaccard.join_groups(frame.where(F.col("text") != " ".join(base))).collect()}
    assert got == jaccard_groups(some, 3, 90, 100)


def test_jaccard_of_very_different_sizes(spark):
    """A set and its superset of twice the size link at one half, several size classes apart."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        size = int(rng.integers(20, 400))
        some = [f"g{i}w{j}" for j in range(size)]
        more = some + [f"g{i}x{j}" for j in range(size if i % 2 else size - 1)]
        rows += [(3 * i, " ".join(some)), (3 * i + 1, " ".join(more)), (3 * i + 2, " ".join(more + [f"g{i}y"] * 1))]
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in ngram_jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=1, num=50, den=100).collect()}
    assert got == jaccard_groups(rows, 1, 50, 100) and len({c for _, c in got.values()}) == 40


def test_size_classes_meet_every_partner():
    for num, den in ((1, 2), (3, 5), (7, 10), (4, 5), (9, 10)):
        classes = ngram_jaccard.Classes(num, den)
        of = {s: set(classes.of(s)) for s in range(1, 900)}
        for s in range(1, 450):
            for t in range(s + 1, s * den // num + 1):
                assert of[s] & of[t]


def test_low_thresholds_are_refused(empty):
    with pytest.raises(ValueError):
        ngram_jaccard.join_groups(empty, num=49, den=100)


def test_jaccard_of_an_empty_table(empty):
    assert ngram_jaccard.join_groups(empty).count() == 0


def test_common_shingles_are_told_from_the_same_share_at_any_size(spark):
    """A passage of 120 documents is common in a large table, too."""
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(6)) + (" a passage that many documents hold" if i < 120 else "")) for i in range(600)]
    texts = spark.createDataFrame(rows, "key long, text string")
    assert len(ngram_jaccard.common_tokens(texts, 3, 1_000_000)) == 4


def test_only_sets_that_share_a_bucket_with_the_other_group_are_listed(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 8)
    kept, listed = {}, []
    stored, admitted = ngram_jaccard.stored, ngram_jaccard._admitted
    monkeypatch.setattr(ngram_jaccard, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    monkeypatch.setattr(ngram_jaccard, "_admitted", lambda rows, num, den: listed.extend(rows.select("group_a", "group_b", "first", "key").distinct().collect()) or admitted(rows, num, den))
    rng = random.Random(5)
    rows = []
    for i in range(160):
        text = [f"w{j}" for j in range(60)]
        for _ in range(rng.choice([4, 6, 8])):
            text[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = ngram_jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string"), num=70)
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got.collect()} == jaccard_groups(rows, 3, 70, 100)
    codes, home = {}, {r["key"]: r["group"] for r in kept["jaccard-groups"].collect()}
    for r in kept["jaccard-buckets"].collect():
        codes.setdefault(r["code"], set()).add(r["key"])
    meets = {(key, home[other]) for keys in codes.values() for key in keys for other in keys if key != other}
    assert listed and all((r["key"], r["group_b"] if r["first"] else r["group_a"]) in meets for r in listed)


def test_sets_that_only_share_a_passage_are_not_listed(spark, monkeypatch):
    """Three documents a passage, too few for its shingles to be common; no row is made for sets that their sketches rule out."""
    listed, admitted = [], ngram_jaccard._admitted
    monkeypatch.setattr(ngram_jaccard, "_admitted", lambda rows, num, den: listed.extend(rows.select("key").collect()) or admitted(rows, num, den))
    rows = [(3 * p + d, " ".join([f"own{p}x{d}x{j}" for j in range(12)] + [f"passage{p}x{j}" for j in range(30)])) for p in range(40) for d in range(3)]
    got = ngram_jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string"), num=70)
    assert {(r["key"], r["n_shingles"], r["component"]) for r in got.collect()} == {(k, 40, k) for k, _ in rows}
    assert not listed


def test_large_buckets_are_compared_in_blocks_and_units(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 3)
    monkeypatch.setattr(ngram_jaccard, "UNIT_ROWS", 5)
    rng, rows = random.Random(9), []
    for i in range(120):
        text = [f"w{j}" for j in range(60)]
        for _ in range(rng.choice([4, 6, 8])):
            text[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
        rows += [(i, " ".join(text)), (i, "another text " + " ".join(text[:40]))][: 2 if i % 10 == 0 else 1]
    got = ngram_jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), num=70)
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got.collect()} == jaccard_groups(rows, 3, 70, 100)


@pytest.mark.parametrize("share", [0, 2, 1])  # no shingle is common, every other one, all
def test_common_shingles_never_change_the_groups(spark, monkeypatch, share):
    import random

    rng, rows = random.Random(3), []
    for i in range(60):
        text = [f"w{i % 6}x{j}" for j in range(50)]
        text[rng.randrange(50)] = f"new{i}"
        rows.append((i, " ".join([*text, "a line that all of these documents hold"])))
    shingles = np.unique(np.concatenate([ngram_jaccard.shingle_set(words[p:q], 3) for _, _, words, at in each_step(pa.array([x for _, x in rows])) for p, q in zip(at, at[1:], strict=False)]))
    monkeypatch.setattr(ngram_jaccard, "common_tokens", lambda texts, n, documents: shingles[::share] if share else shingles[:0])
    got = ngram_jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string"), num=80)
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got.collect()} == jaccard_groups(rows, 3, 80, 100)
