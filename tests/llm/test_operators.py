"""The operators against brute force and in edge cases, on small tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionforge.llm import bin_slack, jaccard, mixing, ngram_bayes, repeated_lines, rule_ensemble
from sessionforge.llm.common import components, n_words, positions
from sessionforge.llm.host_reputation import judge_urls
from sessionforge.llm.kd_shards import kd_shards

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, repeated rows, nulls, empty, short and long texts, a clashing extra column."""
    rng = np.random.default_rng(1)
    base = text(rng, 120)
    words = base.split()
    rows = [(0, base, "en", "a", 1), (1, base, "en", "b", 1), (2, " ".join([*words[:60], "x", *words[61:]]), "en", "a", 1), (3, None, "en", None, None), (4, "", None, "b", 0), (5, "one two", "de", "c", 1), (6, "one two", "de", "a", 1)]
    rows += [(7, text(rng, 3000) + "\n" + base, "en", "a", 1), (8, base + "\n" + text(rng, 80) + "\n" + base, "en", "a", 1), (9, " \n\t ", "en", "a", 1), (None, text(rng, 30), "en", "a", 1), (10, text(rng, 90), "fr", "c", 1), (10, text(rng, 90), "fr", "c", 1)]
    rows += [(20 + i, text(rng, int(n)), "en", "abc"[i % 3], 1) for i, n in enumerate(rng.integers(1, 200, 40))]
    rows += [rows[20], rows[20]]
    return spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash")).withColumn("size", F.lit("clash")).cache()


def test_words_are_counted_like_the_pattern(spark):
    import re

    cases = ["", " ", "a", " a", "a ", " a b ", "a\n\nb", "\x0b\x0c a\r\n", "  b", "a\tb c", None]
    got = [r[0] for r in spark.createDataFrame([(c, i) for i, c in enumerate(cases)], "t string, i int").select(n_words(F.col("t"))).collect()]
    assert got == [len(re.findall("[^\\x20\\x09-\\x0D]+", c or "")) for c in cases]


def test_components_and_positions(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, 101), (5, 5)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {100: 100, 101: 100}
    df = spark.createDataFrame([("a" if i % 3 else None, i, i % 5) for i in range(50)], "g string, i int, w int")
    rows = positions(df, ["g"], ["i"], weight="w", name="at").collect()
    for r in rows:
        assert r["at"] == sum(x["w"] for x in rows if x["g"] == r["g"] and x["i"] < r["i"])


def test_urls(spark):
    rows = [(1, "https://X.Example.NET/en/5"), (2, "http://a.net/q"), (3, "http://b.example.com/de/1?x"), (4, "ftp://fr.org/fr/2"), (5, None), (6, "no scheme"), (7, "http://ok.com/en/3#a"), (7, "http://ok.com/en/3#a"), (8, "http://net")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(3, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, labels).collect()}
    assert got[1] == ("x.example.net", "/en/5", "example.net/en/", "allow") and got[2] == ("a.net", "/q", "net/", "block")
    assert got[3] == ("b.example.com", "/de/1", "example.com/de/", "block") and got[4] == ("fr.org", "/fr/2", "org/fr/", "allow")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[8] == ("net", "", None, got[8][3])
    assert judge_urls(pages.where("page_id < 0"), labels.where("doc_id < 0")).count() == 0


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    per = {}
    for r, taken in ((r, r["taken"]) for r in rows):
        k = (r["source_size"], r["target"])
        per[k] = per.get(k, 0) + taken
    assert all(abs(v - t) <= 64 for (_, t), v in per.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(n_words(F.col("text")))).collect()[0][0] == sum(r["taken"] for r in rows)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, weight, most, full = 1740.0, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 20, "b": 2000, "c": 200, "d": 0, None: 100}, {}
    while True:
        share = {s: left * w / sum(x for k, x in weight.items() if k not in full) for s, w in weight.items() if s not in full}
        over = [s for s in share if share[s] > most[s]]
        if not over:
            break
        for s in over:
            full[s] = most[s]
        left = 1740.0 - sum(full.values())
    assert got == pytest.approx(full | share)


def test_shards(spark, docs):
    rows = kd_shards(docs).collect()
    assert len(rows) == docs.count() and {r["law"] for r in rows} == {"bytes"}
    for s in {r["shard"] for r in rows}:
        assert 0 <= s < 24 and sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    got = {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows}
    assert got == {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8) for r in docs.collect()}
    assert kd_shards(docs.where("doc_id < 0")).count() == 0


def test_jaccard_against_brute_force(spark, docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(one).collect()}
    sets = {}
    for r in one.collect():
        w = (r["text"] or "").split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a, s in sets.items():
        n = sum(1 for b, t in sets.items() if a != b and s and t and len(s & t) >= 0.8 * len(s | t))
        assert got[a]["n_links"] == n, a
    assert got[1]["class_id"] == 0 and got[2]["class_id"] == 0 and got[6]["class_id"] == 5 and got[3]["kept"] and got[4]["kept"]
    assert jaccard.jaccard_join(docs).count() == docs.count()
    assert jaccard.jaccard_join(docs.where("doc_id < 0")).count() == 0
    assert 1 - jaccard.least_band_recall() < 1e-6


def test_one_doc_id_with_several_texts(spark):
    """Every text has its own class, and of each class just one row stays."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    a, b, c, d = (text(rng, 100) for _ in range(4))
    near_a, near_b = (" ".join([*t.split()[:50], "x", *t.split()[51:]]) for t in (a, b))
    texts = [(5, a), (5, b), (5, b), (3, c), (5, c), (6, d), (6, None)]
    texts += [(i, a) for i in range(11, 15)] + [(15, near_a)] + [(i, b) for i in range(21, 25)] + [(25, near_b), (30, d), (31, text(rng, 100))]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], DOCS)
    rows = jaccard.judged(df).join(df.select(F.col("doc_id").alias("i"), "text").distinct(), (F.col("doc_id") == F.col("i")) & F.col("th").eqNullSafe(jaccard.text_hash())).collect()
    assert len(rows) == len(texts)
    groups = {a: (5, 5), near_a: (5, 5), b: (5, 6), near_b: (5, 6), c: (3, 1), d: (6, 1), None: (6, 0)}
    for r in rows:
        class_id, n_links = groups.get(r["text"], (31, 0))
        assert (r["class_id"], r["n_links"]) == (class_id, n_links), r
        assert r["kept"] == (r["doc_id"] == class_id), r
    left = corpus_pipeline.keep_one_of_near_copies(spark, df, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(5, a), (5, b), (3, c), (6, d), (6, None), (31, texts[-1][1])])


def test_posterior_pruning_keeps_pairs_at_the_threshold():
    assert 0 < jaccard.LEAST[16] < 13 and jaccard.LEAST[128] < 0.8 * 128
    rng = np.random.default_rng(3)
    left = rng.integers(0, 256, (50, jaccard.HASHES), dtype="uint8")
    same = rng.random((50, jaccard.HASHES)) < 0.8
    right = np.where(same, left, rng.integers(0, 256, left.shape, dtype="uint8")).astype("uint8")
    assert np.diag(jaccard.survivors(left, right)).all() and jaccard.survivors(left, right).sum() == 50


def test_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(900, "a<|endoftext|> b"), (901, "<|endoftext|>"), (902, text(np.random.default_rng(30), 30_000)), (903, "x" * 5000), (902, None)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumn("length", F.lit("clash"))
    rows = bin_slack.pack(docs).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    want = Counter()
    for d in docs.collect():
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for piece, (start, length) in enumerate(bin_slack.pieces_of(len(ids), 2048)):
            want[d["doc_id"], piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert bin_slack.pack(docs.where("doc_id < 0")).count() == 0


def test_tokens_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bin_slack.encoder()
    rng = np.random.default_rng(31)
    cases = ["a  b\n\n c", "<|endoftext|> a", "a<|endoftext|><|endoftext|>", "<|endoftext", "é中文 \U0001f600‍!", "it's  'LL 12٣", "  x　", "x" * 3000, "\r\n\t \x0b", ""]
    cases += ["".join(chr(c) for c in rng.integers(1, 0xD7FF, 60)) for _ in range(300)] + ["".join(rng.choice(list(" \n\tab'sé1<|>"), 40)) for _ in range(300)]
    import pyarrow.parquet as pq

    cases += [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if x]
    assert [t.encode(c, add_special_tokens=False).ids for c in cases] == [list(i) for i in encode(cases)]
    assert [list(i) for i in encode(cases[:40])] == [list(i) for i in bin_slack.encoder(ranks=None)(cases[:40])]
    assert list(encode(["<|endoftext|> a"])[0]) == [50256, 257]


def test_fullest_combination_is_the_best():
    rng = np.random.default_rng(5)
    for _ in range(60):
        left = Counter(rng.integers(1, 30, 9).tolist())
        used = bin_slack.fullest(dict(left), 50)
        sums = {max(left)}
        for n, k in (left - Counter([max(left)])).items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 50) and all(left[n] >= k for n, k in used.items())


def brute_lines(rows, least=50):
    first, gone = set(), {}
    for doc_id, t in rows:
        lines = t.split("\n")
        runs, out = [], set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= least:
                    runs.append((tuple(lines[i:j]), i, j))
        for run, i, j in runs:
            if run in first:
                out |= set(range(i, j))
            first.add(run)
        gone[doc_id] = sorted(out)
    return gone


def test_repeated_lines(spark, docs):
    rng = np.random.default_rng(6)
    pool = [text(rng, n) for n in (20, 30, 5, 60, 0, 12)]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 6, n)), "en", "a", 1) for i, n in enumerate(rng.integers(1, 9, 25))]
    got = {r["doc_id"]: list(r["removed"]) for r in repeated_lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_lines([(r[0], r[1]) for r in rows])
    out = {r["doc_id"]: r for r in repeated_lines.dedup_lines(docs).collect()}
    assert out[3]["text"] is None and out[1]["text"] == "" and list(out[7]["removed"]) == [1] and list(out[8]["removed"]) == [0, 2]
    assert repeated_lines.dedup_lines(docs.where("doc_id < 0")).count() == 0


def test_long_texts_and_a_hot_line(spark):
    rng = np.random.default_rng(21)
    lines = [text(rng, 9) for _ in range(6000)]
    common = "the same line in all"
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[100:5000])), (3, "\n".join(["x", *lines[10:14], "y", *lines[20:40]])), (4, "\n".join([common] * 3000)), (5, "\n".join([common, lines[0], common]))]
    got = {r["doc_id"]: r for r in repeated_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["removed"] and got[2]["text"] == "" and list(got[3]["removed"]) == list(range(6, 26))
    # runs of 50 words of the common line repeat from the second line on
    assert list(got[4]["removed"]) == list(range(1, 3000)) and got[4]["text"] == common and not got[5]["removed"]


def test_a_large_cluster_of_near_copies_and_long_texts(spark):
    rng = np.random.default_rng(22)
    base, rows = text(rng, 90).split(), []
    for i in range(620):
        w = list(base)
        for k in rng.integers(0, 90, int(rng.integers(0, 4))):
            w[k] = f"x{rng.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    long = text(rng, 25_000).split()
    rows += [(1000, " ".join(long)), (1001, " ".join([*long[:500], "x", *long[500:]])), (1002, text(rng, 25_000))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    links, root = Counter(), {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)

    def top(i):
        return i if root[i] == i else top(root[i])

    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (links[i], top(i)) for i in ids} and got[1001] == (1, 1000)


def test_classifiers(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", None, None, None)], d.schema)
    for score, column, fold in ((ngram_bayes.toxicity_scores, "toxic", (5, 0)), (rule_ensemble.quality_scores, "quality", (3, 1))):
        got = score(d.union(extra), lab).toPandas()
        assert len(got) == 202 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
        assert (got["held_out"] == got["doc_id"].map(lambda i, f=fold: zlib.crc32(str(i).encode()) % f[0] == f[1])).all()
        told = got[~got["held_out"]].merge(lab.toPandas(), on="doc_id")
        assert (told["predicted"] == told[column]).mean() > 0.9
        none = score(d, lab.where("doc_id < 0")).toPandas()
        assert none["score"].nunique() == 1


def test_learned_from_training_fold_only(spark):
    """Labels of the held-out fold don't change a score."""
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(T.IntegerType()))
    a, b = (ngram_bayes.toxicity_scores(d, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (lab, other))
    assert np.allclose(a, b)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
            docs = out.cache()
    assert out.where("offset + length > 2048").count() == 0
