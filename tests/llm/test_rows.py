"""Line dedup, mixing, chats, vectors and the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import ann, chat_format, components, embedding_dedup, line_dedup, mixing
from skyledger.llm.queries import ORACLES, QUERIES

from .plain import Groups, jaccard_groups, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = con.execute(ORACLES[name]).df()
    got, expected = (x[sorted(x.columns)].sort_values(sorted(x.columns), ignore_index=True) for x in (got, expected))
    assert list(got.columns) == list(expected.columns) and len(got) == len(expected)
    for c in got.columns:
        assert got[c].dtype == expected[c].dtype and (got[c].fillna("") == expected[c].fillna("")).all() if got[c].dtype == object else (got[c] == expected[c]).all(), c


def plain_line_dedup(docs):
    """(text, lost lines, lost runs) per document in the order in which first occurrences stay."""
    seen, out = set(), []
    for text in docs:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        links = [(lines[i], lines[j]) for i, j in zip(full, full[1:], strict=False)]
        again = []
        for link in links:
            again.append(link in seen)
            seen.add(link)
        gone = {i for o, lost in enumerate(again) if lost for i in range(full[o], full[o + 1] + 1)}
        runs = sum(lost and not (o and again[o - 1]) for o, lost in enumerate(again))
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone), runs))
    return out


def test_line_dedup(edge, edge_rows, empty):
    out = line_dedup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "__lines", "__removed_lines", "__removed_chunks"]
    got = Counter((r["doc_id"], r["text"], r["__removed_lines"], r["__removed_chunks"], r["key"]) for r in out.collect())
    unique = sorted({r[:2] for r in edge_rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[0] == 500 and "another" in r[1]))
    kept = dict(zip(unique, plain_line_dedup([t for _, t in unique]), strict=True))
    assert got == Counter((r[0], *kept[r[0], r[1]], r[5]) for r in edge_rows)
    assert sum(n for _, _, n, _, _ in got) > 10
    assert line_dedup.dedup_lines(empty).count() == 0


def test_columns_named_like_the_results(edge):
    twice = line_dedup.dedup_lines(line_dedup.dedup_lines(edge))
    assert twice.columns == [*edge.columns, "__lines", "__removed_lines", "__removed_chunks"] and twice.agg(F.sum("__removed_lines")).first()[0] == 0


def test_short_passages_in_differing_contexts(spark):
    """Passages of 2 to 12 lines, each in three documents between lines of their own: two of them lose the passage, whole, and nothing else."""
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(8))
    rows, expected = [], {}
    for n in range(2, 13):
        for _ in range(3):
            passage = [line() for _ in range(n)]
            spaced = [x for y in passage for x in (y, "")][:-1]  # a blank line after each: still the same passage
            for copy in range(3):
                before, after = [line() for _ in range(rng.randint(0, 6))], [line() for _ in range(rng.randint(0, 6))]
                body = spaced if copy == 2 else passage
                expected[len(rows)] = (len(body) if copy else 0, "\n".join(before + ([] if copy else body) + after))
                rows.append((len(rows), "\n".join(before + body + after)))
    got = {r["doc_id"]: (r["__removed_lines"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_texts_of_many_lines_take_linear_work(spark):
    import time

    text = "\n".join(f"line {i % 15_000} of a long text" for i in range(30_000))
    started = time.monotonic()
    (row,) = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row["__lines"], row["__removed_lines"], row["__removed_chunks"]) == (30_000, 15_000, 1) and len(row["text"].split("\n")) == 15_000
    assert time.monotonic() - started < 60


def test_every_line_stays_somewhere(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x for r in out for x in r["text"].split("\n")} >= set("abcdef") and sum(r["__removed_lines"] for r in out) > 100



def test_mixing(edge, edge_rows, empty):
    rows = mixing.mix_sizes(mixing.draws(edge)).collect()
    again = mixing.mix_sizes(mixing.draws(edge.repartition(7))).collect()
    pick = lambda rs: Counter((r["doc_id"], r["text"], r["__copies"]) for r in rs)
    assert pick(rows) == pick(again)
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len(words(r[1]))
    assert {(r["source"], r["source_size"]) for r in rows} == set(sizes.items())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 2 * sizes[s]}
        if not over:
            target.update({s: left * weights[s] / total for s in free})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    taken, widest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["__size"] == len(words(r["text"])) and 0 <= r["__copies"] <= 2 and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        taken[r["source"]] += r["__size"] * r["__copies"]
        widest[r["source"]] = max(widest[r["source"]], r["__size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= widest[s]
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["__copies"]}) for r in rows), Counter())
    assert mixing.mix(empty).count() == 0


def test_mixing_of_columns_named_like_its_own(edge):
    named = edge.withColumnRenamed("key", "p").withColumnRenamed("score", "target").withColumnRenamed("size", "rank").withColumnRenamed("offset", "__mix")
    plain = Counter((r["doc_id"], r["text"], r["__copies"], r["target"]) for r in mixing.mix_sizes(mixing.draws(edge)).collect())
    out = mixing.mix_sizes(mixing.draws(named))
    assert len(out.columns) == len(set(out.columns)) and Counter((r["doc_id"], r["text"], r["__copies"], r["target"]) for r in out.collect()) == plain
    assert mixing.mix(named).columns == named.columns


def test_inclusion_rates_follow_the_sizes(spark):
    """Over many seeds a document is sampled as often as its inclusion probability says, and the words come near what is left."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 400] * 4
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(sizes)], "doc_id int, text string")
    seeds, left = 300, 0.4 * sum(sizes)
    runs = docs.select("doc_id", F.regexp_count("text", F.lit("w")).cast("long").alias("__size"), F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    digest = F.md5(F.concat_ws(":", "seed", "doc_id").cast("binary"))
    runs = runs.select("doc_id", "__size", F.lit(False).alias("__no_source"), F.format_string("%05d", "seed").alias("__source"), F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").alias("__draw"))
    goals = runs.select("__no_source", "__source").distinct().select("*", F.lit(sum(sizes)).cast("long").alias("source_size"), F.lit(left).alias("target"), F.lit(0).cast("long").alias("whole"), F.lit(left).alias("left"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "targets", lambda rows: goals)
        out = mixing.mix_sizes(runs)
        found = out.groupBy("doc_id").agg(F.avg("__copies").alias("rate"), F.first("__size").alias("size")).collect()
        words = [r[0] for r in out.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__copies"))).select("sum((__size * __copies))").collect()]
    certain = [n for n in sizes]
    bound, scale = max(sizes) + 1, None
    for n in sorted(set(sizes), reverse=True):
        scale = (left - sum(x for x in certain if x > n)) / sum(x * x for x in sizes if x <= n)
        bound = n
        if scale * n <= 1:
            break
    for r in found:
        p = 1.0 if r["size"] > bound else scale * r["size"]
        assert abs(r["rate"] - p) <= 4 * np.sqrt(max(p * (1 - p), 0.01) / seeds) + 0.04
    assert all(abs(w - left) <= max(x for x in sizes if x <= bound) for w in words)


def test_recall_of_nearest_neighbours_on_the_provided_table(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] is not None]
    found = defaultdict(set)
    for r in QUERIES["op8_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect():
        found[r["query_id"]].add(r["vec_id"])
    usable = [r for r in rows if all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, vectors = np.array([r["vec_id"] for r in usable]), np.array([r["embedding"] for r in usable], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        hits, total = hits + len(found[int(ids[q])] & set(best.tolist())), total + len(best)
    assert total > 400 and hits >= 0.9 * total


def test_chat_trees(spark):
    control = "</s>[INST] ok [/INST] <|im_end|>\n \\ \\\\ <\\| <<SYS>> <|im_start|>x<|im_sep|>"
    rows = [
        (1, "a", None, 0, "user", "hi", 1.0), (1, "b", "a", 1, "assistant", "low", 1.0), (1, "c", "a", 1, "assistant", control, 5.0), (1, "d", "c", 2, "user", "", None),
        (1, "e", "b", 2, "user", "longer", 1.0), (1, "f", "e", 3, "assistant", "still", 1.0),
        (2, "a", "missing", 0, "assistant", "orphan", 0.0), (2, "b", "c", 1, "user", "late parent", 0.0), (2, "c", "b", 2, "user", "x", 0.0),
        (3, "a", None, 0, None, None, 0.0), (3, "a", None, 0, None, None, 0.0), (None, "z", None, None, "we\nird", control, 0.0), (None, "y", "z", 1, "assistant", "tail<", 0.0),
    ]
    rows += [(4, f"m{i:03}", f"m{i - 1:03}" if i else None, i, "assistant" if i % 2 else "user", f"t{i}\n", 0.1) for i in range(45)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, message_id string, parent_id string, turn int, role string, text string, score double, formatted string")
    out = chat_format.format_chats(frame)
    read = out.select("__conv", "__leaf", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("masked")).collect()
    got = {r["__conv"]: (r["__leaf"], [tuple(t) for t in r["turns"]], r["masked"]) for r in read}
    assert got[1] == ("d", [("user", "hi"), ("assistant", control), ("user", "")], [control])
    assert got[2] == ("c", [("user", "late parent"), ("user", "x")], [])
    assert got[3] == ("a", [("", "")], [])
    assert got[None] == ("y", [("we\nird", control), ("assistant", "tail<")], ["tail<"])
    assert got[4][1] == [("assistant" if i % 2 else "user", f"t{i}\n") for i in range(45)] and got[4][2] == [f"t{i}\n" for i in range(1, 45, 2)]
    assert len(got) == len(read) == 5
    both = {(r["__conv"], r["__leaf"]) for r in chat_format.format_chats(frame, branches=2).collect()}
    assert {(1, "d"), (1, "f"), (2, "a"), (2, "c")} <= both and len(both) == 7
    assert chat_format.format_chats(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[7] * s).tolist(), 1) for i, s in enumerate([1, 1, 1, 2.0])]
    rows += [(2000 + i, (base[9] + rng.normal(size=12) * 0.04 * np.linalg.norm(base[9]) / 3).tolist(), 0 if i % 4 else None) for i in range(40)]
    rows += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [1.0] * 11 + [None], 1), (3003, [float("nan")] * 12, 1), (3004, [float("inf")] + [1.0] * 11, 1), (3005, [1.0, 2.0], 1), (None, base[0].tolist(), 0)]
    rows += [rows[3], rows[100]]
    return rows, spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<double>, label int, score string, rank int")


def usable(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize("block", [16, 4])  # with 4, buckets are pairs of axes
def test_nearest(vectors, monkeypatch, block):
    rows, frame = vectors
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    got = ann.nearest(frame, frame.where("vec_id % 4 = 0"), 5).collect()
    known = {k: np.array(v) for k, v, _ in rows if k is not None and usable(v) and len(v) == 12}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - known[r["query_id"]] @ known[r["vec_id"]]) < 1e-9 and r["vec_id"] != r["query_id"]
        found[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in [k for k in known if k % 4 == 0]:
        best = sorted((k for k in known if k != q), key=lambda k: (-round(float(known[q] @ known[k]), 9), k))[:5]
        hits += len(set(best) & set(found[q]))
        assert len(found[q]) == 5
    assert set(found) == {k for k in known if k % 4 == 0} and hits >= 0.9 * 5 * len(found)
    everything = ann.nearest(frame, frame.where("vec_id = 1000"), 5, probes=10**6).collect()
    best = sorted((k for k in known if k != 1000), key=lambda k: (-round(float(known[1000] @ known[k]), 9), k))[:5]
    assert [r["vec_id"] for r in sorted(everything, key=lambda r: r["rank"])] == best and {7, 1001, 1003} <= set(best)
    assert ann.nearest(frame.limit(0), frame, 5).count() == 0 and ann.nearest(frame, frame.limit(0), 5).count() == 0


def test_probed_buckets_make_no_rows(vectors, monkeypatch):
    """A query is one row however many buckets it probes; many blocks, whose first rows rule out others, give the same neighbours."""
    rows, frame = vectors
    kept, stored = {}, ann.stored
    monkeypatch.setattr(ann, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    monkeypatch.setattr(ann, "BLOCK_VALUES", 12 * 64, raising=False)
    monkeypatch.setattr(ann, "QUERY_VALUES", 12 * 30, raising=False)
    monkeypatch.setattr(ann, "HEAD_ROWS", 8, raising=False)
    got = ann.nearest(frame, frame.where("vec_id % 4 = 0"), 5, probes=10**6).collect()
    assert kept["ann-probes"].count() == kept["ann-queries"].count()
    known = {k: np.array(v) for k, v, _ in rows if k is not None and usable(v) and len(v) == 12}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    for q in [k for k in known if k % 4 == 0]:
        assert found[q] == sorted((k for k in known if k != q), key=lambda k: (-round(float(known[q] @ known[k]), 9), k))[:5]


@pytest.mark.parametrize("threshold", [0.98, 0.7])
def test_embedding_groups(vectors, monkeypatch, threshold):
    rows, frame = vectors
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "FAN", 2)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame, threshold=threshold).collect()}
    known = {k: (np.array(v) / np.linalg.norm(v), label) for k, v, label in rows if k is not None and usable(v) and label is not None}
    groups, links = Groups(), Counter()
    for a, (u, x) in known.items():
        for b, (v, y) in known.items():
            if a < b and x == y and len(u) == len(v) and u @ v >= threshold:
                groups.tie(a, b)
                links.update([a, b])
    keys = {k for k, _, _ in rows if k is not None}
    assert got == {k: (links[k], groups.find(k), groups.find(k) == k) for k in keys}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.tie(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: groups.find(k) for k in groups.up}


def test_pipeline_stages(spark, edge, edge_rows, empty):
    docs = edge
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    known = stages["language_id"](spark, docs, "").cache()
    assert known.columns == docs.columns
    assert Counter(r["doc_id"] for r in known.collect()) == Counter(r[0] for r in edge_rows if any(c.isalpha() for c in r[1] or ""))
    lines = stages["line_dedup"](spark, known, "").cache()
    assert lines.columns == docs.columns and all(r["text"].strip() for r in lines.collect())
    single = stages["ngram_jaccard"](spark, docs, "").collect()
    groups = jaccard_groups([r[:2] for r in edge_rows], 5, 80, 100)
    assert Counter(r["doc_id"] for r in single) == Counter(r[0] for r in edge_rows if r[0] is None or groups[r[0]][1] == r[0])
    mixed = stages["mixing"](spark, lines, "")
    assert mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()
    for stage in stages.values():
        assert stage(spark, empty, "").count() == 0


def test_junk_has_no_known_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(8)
    junk = {
        -1: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)),
        -2: " ".join("".join(rng.choice("абвгдежзиклмнопрстуфхцчшщыэюя") for _ in range(rng.randint(2, 9))) for _ in range(400)),
        -3: "#" * 3000 + "a" + "*" * 3000,
        -4: "".join(rng.choice("#*=-_/|<>0123456789 ab") for _ in range(4000)),
    }
    clean = docs.where("lang IS NOT NULL AND length(text) > 500").limit(20).collect()
    short = {-10 - i: " ".join(r["text"].split()[:12]) for i, r in enumerate(clean)}
    added = spark.createDataFrame([(k, x) for k, x in (junk | short).items()], "doc_id long, text string")
    both = docs.unionByName(added, allowMissingColumns=True)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, both, "").select("doc_id").collect()}
    assert not kept & set(junk) and set(short) <= kept
    named = {r["doc_id"] for r in docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'").collect()}
    assert len(kept & named) >= 0.98 * len(named)


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
