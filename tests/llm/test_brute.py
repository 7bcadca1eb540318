"""Operators that SQL can't express, against plain loops: mixing, shards, quality, toxicity, reputation and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionforge.llm import bin_slack, host_reputation, kd_shards, mixing, ngram_bayes, rule_ensemble

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(300)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def hashed(*values):
    """Hash of numbers as 64-bit values (int32: a 1-tuple) or texts, as SQL's xxhash64 gives it; null leaves the seed."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return signed(h)


def permuted(i, n, *key):
    for r in range(1, mixing.ROUNDS + 1):
        y = (hashed(*key, (r,)) % n - i) % n
        if hashed(max(i, y), *key, (r,)) % 2 == 0:
            i = y
    return i


def mixed_by_loop(rows):
    """{row number: words taken}, by drawing slot after slot."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(total.values())
    while True:
        share = {s: (left - sum(full.values())) * weight[s] / sum(w for k, w in weight.items() if k not in full) for s in names if s not in full}
        over = {s: 2.0 * total[s] for s in share if share[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = full | share
    blocks = {s: -(-total[s] // mixing.BLOCK_WORDS) for s in names}
    quota = {s: min(2 * blocks[s], math.floor(target[s] * blocks[s] / total[s] + 0.5)) if total[s] else 0 for s in names}
    slots, ends = sum(quota.values()), np.cumsum([quota[s] for s in names])
    drawn = [int(np.searchsorted(ends, hashed((mixing.SEED,), k // mixing.SHARD_SLOTS, k % mixing.SHARD_SLOTS) % slots, side="right")) for k in range(slots)]
    seen, fine, spare = Counter(), [], defaultdict(list)
    for k in drawn:
        if seen[k] < quota[names[k]]:
            fine.append((k, seen[k]))
        else:
            spare[k].append(seen[k])
        seen[k] += 1
    fine += [(k, j) for k, s in enumerate(names) for j in range(seen[k], quota[s])]
    copies = Counter((k, permuted(j % blocks[names[k]], blocks[names[k]], (k,), j // blocks[names[k]])) for k, j in fine)
    taken = {}
    for k, s in enumerate(names):
        at = 0
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        for i in sorted(mine, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashed(rows[i][1]))):
            taken[i] = sum(copies[k, w // mixing.BLOCK_WORDS] for w in range(at, at + size[i]))
            at += size[i]
    return size, target, taken


def test_words_taken_equal_the_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(i, text(rng, int(n)), "abcd"[i % 4] if i % 9 else None) for i, n in enumerate(rng.integers(0, 150, 80))]
    rows += [(80, None, "a"), (81, "", "b"), (82, text(rng, 20_000), "c"), (82, text(rng, 30), "c"), (None, text(rng, 40), "a"), (83, text(rng, 9), "z"), (7, rows[7][1], "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit("clash"))
    size, target, taken = mixed_by_loop(rows)
    got = sorted(((r["doc_id"], r["size"], r["taken"], round(r["target"], 6)) for r in mixing.mix(df).collect()), key=str)
    assert got == sorted(((r[0], size[i], taken[i], round(target[r[2]], 6)) for i, r in enumerate(rows)), key=str)
    assert all(taken[i] <= 2 * size[i] for i in taken)


def shards_by_loop(rows, shards=24):
    """Shard of each (doc_id, text), by sorting each node's rows along its widest dimension."""
    data = []
    for doc_id, t in rows:
        b = (t or "").encode()
        n = len(t or "")
        dims = (n, math.floor((len(b) / n - 1) * 2**20) if n else 0, (t or "").count("\n") + 1)
        data.append((doc_id, len(b) + 8, zlib.crc32(b), dims))
    whole = [max(1, max(d[3][k] for d in data) - min(d[3][k] for d in data)) for k in range(3)]
    out = {}

    def split(mine, first, n):
        if n == 1 or not mine:
            out.update({i: first for i in mine})
            return
        k = max(range(3), key=lambda k: (max(data[i][3][k] for i in mine) - min(data[i][3][k] for i in mine)) / whole[k])
        key = {i: (data[i][3][k], data[i][2]) for i in mine}
        total = sum(data[i][1] for i in mine)
        goal, below, at = total * (n // 2) / n, 0, None
        for at in sorted(set(key.values())):
            here = sum(data[i][1] for i in mine if key[i] == at)
            if below + here >= goal:
                break
            below += here
        if here <= total / n:
            left = [i for i in mine if key[i] < at or (key[i] == at and abs(below + here - goal) <= abs(below - goal))]
        else:
            left, held = [i for i in mine if key[i] < at or (key[i] == at and data[i][0] is None)], below
            for d in sorted({data[i][0] for i in mine if key[i] == at and data[i][0] is not None}):
                same = [i for i in mine if key[i] == at and data[i][0] == d]
                left += same
                held += sum(data[i][1] for i in same)
                if held >= goal:
                    break
        split(left, first, n // 2)
        split([i for i in mine if i not in set(left)], first + n // 2, n - n // 2)

    split(list(range(len(data))), 0, shards)
    return [(data[i][0], data[i][2], out[i]) for i in range(len(data))]


def test_shards_equal_the_loop_and_keep_copies(spark):
    rng = np.random.default_rng(12)
    rows = [(i, text(rng, int(n)) + "\né" * int(n % 7)) for i, n in enumerate(rng.integers(0, 60, 300))]
    rows += [(1000 + i, rows[5][1]) for i in range(4)] + [(2000, None), (2001, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = sorted(((r["doc_id"], r["text_crc32"], r["shard"]) for r in kd_shards.kd_shards(df).collect()), key=str)
    assert got == sorted(shards_by_loop(rows), key=str)
    of = defaultdict(set)
    for _, crc, shard in got:
        of[crc].add(shard)
    assert all(len(s) == 1 for s in of.values())
    # a text that outweighs many leaves is shared out among them, by doc_id
    heavy = [(i, "heavy " * 50) for i in range(200)] + [(1000 + i, text(rng, 40)) for i in range(200)]
    placed = kd_shards.kd_shards(spark.createDataFrame(heavy, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text_crc32"], r["shard"]) for r in placed), key=str) == sorted(shards_by_loop(heavy), key=str)
    weights = Counter()
    for r in placed:
        weights[r["shard"]] += r["size"]
    assert len(weights) == 24 and max(weights.values()) < 1.5 * min(weights.values())


def test_reputations_equal_the_loop(spark):
    rng = np.random.default_rng(13)
    hosts = ["good.com", "a.bad.com", "b.bad.com", "bad.com", "one.org", "x.co.uk", "y.x.co.uk", "co.uk", "z.ac.jp", "solo", ""]
    pages, labels = [], {}
    for i in range(600):
        h = hosts[int(rng.integers(0, len(hosts)))]
        pages.append((i, f"http://{h}/p/{i}" if i % 3 else f"http://{h}/about"))
        labels[i] = int(rng.random() < (0.9 if "bad" in h else 0.5 if h == "x.co.uk" else 0.03))
    pages += [(i, u) for i, u in pages[:5]] + [(9999, None), (9998, "http://new.bad.com/1"), (9997, "http://" + "long" * 5000 + ".org/")]
    told = [(i, 1 - v, 0) if i % 2 else (i, None, v) for i, v in labels.items()]
    got = {r["host"]: (r["n_labelled"], r["bad_rate"], r["bad_bound"]) for r in host_reputation.reputations(spark.createDataFrame(pages, "page_id long, url string").select(host_reputation.host_of(F.col("url")).alias("host"), host_reputation.path_of(F.col("url")).alias("path")), spark.createDataFrame(told, "doc_id long, quality int, toxic int")).collect()}

    host_of = lambda u: u.split("://", 1)[1].split("/")[0].lower() if u and "://" in u else ""
    n, x = Counter(), Counter()
    for _, u in pages:
        m = re.search(r"/([0-9]+)$", (u or "").split("://", 1)[-1].partition("/")[1] + (u or "").split("://", 1)[-1].partition("/")[2])
        n[host_of(u)] += 0
        if m and int(m[1]) in labels:
            n[host_of(u)] += 1
            x[host_of(u)] += labels[int(m[1])]
    two = lambda h: re.search(rf"(^|\.)({'|'.join(host_reputation.SECOND_LEVEL)})\.[a-z][a-z]$", h) is not None
    up = lambda h, k: ".".join(h.split(".")[-k - two(h) :])
    assert up("y.x.co.uk", 2) == "x.co.uk" and up("y.x.co.uk", 1) == "co.uk" and up("b.bad.com", 2) == "bad.com"

    def shrunk(units, parent):
        fit = [(n1, x1, parent(u)) for u, (n1, x1) in units.items() if n1 > 0 and 0 < parent(u) < 1]
        q, m = sum((x1 - n1 * p) ** 2 / (n1 * p * (1 - p)) for n1, x1, p in fit), sum(n1 - 1 for n1, _, _ in fit)
        rho = (q - len(fit)) / m if m > 0 else 0
        s = min(host_reputation.STRONGEST, max(host_reputation.WEAKEST, 1 / rho - 1 if rho > 0 else host_reputation.STRONGEST))
        return {u: ((x1 + s * parent(u)) / (n1 + s), n1 + s) for u, (n1, x1) in units.items()}

    def summed(k):
        out = defaultdict(lambda: (0, 0))
        for h in n:
            out[up(h, k)] = (out[up(h, k)][0] + n[h], out[up(h, k)][1] + x[h])
        return out

    top = (sum(x.values()) + 1) / (sum(n.values()) + 2)
    suffix = shrunk(summed(1), lambda _: top)
    domain = shrunk(summed(2), lambda d: suffix[up(d, 1)][0])
    host = shrunk({h: (n[h], x[h]) for h in n}, lambda h: domain[up(h, 2)][0])
    assert set(got) == set(host)
    for h, (mean, strength) in host.items():
        assert got[h] == (n[h], pytest.approx(mean), pytest.approx(mean - host_reputation.Z * math.sqrt(mean * (1 - mean) / (strength + 1)))), h
    verdicts = {r["page_id"]: r["verdict"] for r in host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(told, "doc_id long, quality int, toxic int")).collect()}
    assert verdicts[9998] == "block" and verdicts[9999] == "allow"  # an unseen host under a bad domain, and no host
    for i, u in pages:
        if host_of(u).endswith("bad.com"):
            assert verdicts[i] == "block"
        elif host_of(u) in ("good.com", "one.org"):
            assert verdicts[i] == "allow"


def odd_docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(14)
    extra = [(10_001, None, None, None, None), (10_002, "", None, None, None), (10_003, text(rng, 60_000), "en", "a", 1), (10_004, " \n\t\x0b ", None, None, None), (10_005, "ÀÉ ß İ \U0001f600 http://x\n\nhttp", None, None, None), (10_005, "same id, other text.", None, None, None)]
    return d.union(spark.createDataFrame(extra + extra[-1:], d.schema)).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))


def test_quality_rules_equal_the_loop(spark, monkeypatch):
    kept, learned = [], rule_ensemble.learned
    monkeypatch.setattr(rule_ensemble, "learned", lambda *a: kept.append(learned(*a)) or kept[-1])
    docs, labels = odd_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = sorted((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in rule_ensemble.quality_scores(docs, labels).collect())
    model, want = kept[0], []
    assert model.rules
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, nw, lines = max(1, len(t)), max(1, len(w)), t.split("\n")
        share = lambda chars: sum(t.count(c) for c in chars) / n  # noqa: E731, B023
        s = {
            "n_words": math.log1p(len(w)), "n_lines": math.log1p(len(lines)), "mean_word": (len(t) - nw + 1) / nw, "symbols": share(rule_ensemble.SYMBOLS), "bangs": share("!?"), "stops": share("."), "parts": share(",;:"),
            "digits": share("0123456789"), "bars": share("|"), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "wide": (len(t.encode()) - len(t)) / n, "distinct_words": len(set(w)) / nw, "distinct_lines": len(set(lines)) / len(lines), "links": 4 * t.count("http") / n,
        }
        z = model.bias + sum(weight for rule, weight in model.rules if all(s[name] > at if above else s[name] <= at for name, above, at in rule.bounds))
        want.append((r["doc_id"], round(1 / (1 + math.exp(-z)), 9), int(1 / (1 + math.exp(-z)) >= 0.5)))
    assert got == sorted(want)


def places_by_loop(t):
    c = [ord(x) for x in " " + " ".join(t.lower().split()) + " "] if t else []
    out = set()
    for n in ngram_bayes.SIZES:
        for i in range(len(c) - n + 1):
            h = n * 97
            for k in range(n):
                h = (h ^ c[i + k]) * int(ngram_bayes._MULTIPLIERS[k]) % 2**32
                h ^= h >> 15
            out.add(h >> (32 - ngram_bayes.BITS))
    return out


def test_toxicity_scores_equal_the_loop(spark, monkeypatch):
    kept, model = [], ngram_bayes.toxic_model
    monkeypatch.setattr(ngram_bayes, "toxic_model", lambda *a: kept.append(model(*a)) or kept[-1])
    docs, labels = odd_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = sorted((r["doc_id"], round(r["score"], 7), r["predicted"]) for r in ngram_bayes.toxicity_scores(docs, labels).collect())
    weights, bias = kept[0]
    rows, want = docs.collect(), []
    for r in rows:
        z = bias + sum(weights[p] for p in places_by_loop(r["text"]))
        want.append((r["doc_id"], round(1 / (1 + math.exp(-max(-40, min(40, z)))), 7), int(z >= 0)))
    assert got == sorted(want)
    # the weights carry the sign of the ratio of counts over all training texts, and only there
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    n, t = np.zeros((2, 2**ngram_bayes.BITS)), [0, 0]
    for r in rows:
        if r["text"] is not None and r["doc_id"] in label:
            n[label[r["doc_id"]], list(places_by_loop(r["text"]))] += 1
            t[label[r["doc_id"]]] += 1
    ratio = ngram_bayes.ratios(n[0], n[1], *t)
    assert (~np.isnan(ratio)).sum() >= (weights != 0).sum() > 100 and not weights[np.isnan(ratio)].any()
    again = ngram_bayes.toxic_model(docs.repartition(5), labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert np.array_equal(again[0], weights) and again[1] == bias


def lines_by_loop(rows, least=50):
    """Texts without the later copies of runs of lines with `least` words; rows in the order of doc_id."""
    first, out = set(), []
    for doc_id, t in rows:
        lines, gone, runs = t.split("\n"), set(), []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= least:
                    runs.append((tuple(lines[i:j]), i, j))
        for run, i, j in runs:
            if run in first:
                gone |= set(range(i, j))
            first.add(run)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), bool(gone)))
    return out


def test_pipeline_equals_the_loops(spark, tmp_path):
    """Planted toxic texts, copies, near copies and passages through all stages, and run() over them."""
    import corpus_pipeline

    rng = np.random.default_rng(15)
    clean, toxic = [f"c{i}" for i in range(200)], [f"xq{i}zz" for i in range(20)]
    say = lambda n, bad=0: " ".join([*rng.choice(clean, n), *rng.choice(toxic, bad)])
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        rows.append((i, "\n".join(say(20, 6 if bad else 0) for _ in range(4))))
        labels.append((i, 1, int(bad)))
    passage = "\n".join(say(30) for _ in range(3))
    rows += [(200, passage + "\n" + say(40)), (201, say(60) + "\n" + passage), (202, rows[1][1])]
    base = say(100).split()
    rows += [(300 + k, " ".join([*base[: 30 + k], "other", *base[31 + k :]])) for k in range(3)]
    rows += [(400, ""), (401, "one two"), (402, "one two"), (403, say(3000))]
    docs = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in rows] + [(404, None, None, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    step = lambda name: stages[name](spark, at, str(tmp_path))

    def kept(name):
        step(name).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    at = kept("toxicity")
    assert at.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    left = {r["doc_id"] for r in at.collect()}
    assert left == {i for i, t, *_ in docs if not (i < 120 and i % 4 == 0)}
    before = sorted((r["doc_id"], r["text"]) for r in at.collect() if r["text"] is not None)
    at = kept("line_dedup")
    want = {(i, t) for i, t, gone in lines_by_loop(before) if not gone or t.split()} | {(404, None)}
    assert {(r["doc_id"], r["text"]) for r in at.collect()} == want and (202, "") not in want
    texts = sorted((r["doc_id"], r["text"] or "") for r in at.collect())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in texts}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = sorted((root[i], root[j]), reverse=True)
                root = {k: new if v == old else v for k, v in root.items()}
    at = kept("jaccard_join")
    assert {r["doc_id"] for r in at.collect()} == {i for i in sets if root[i] == i} and {301, 302, 402}.isdisjoint({r["doc_id"] for r in at.collect()})
    rows_in = [(r["doc_id"], r["text"], r["source"]) for r in at.collect()]
    size, _, taken = mixed_by_loop(rows_in)
    at = kept("mix_sources")
    mixed = {r["doc_id"]: r for r in at.collect()}
    assert {i: len(r["text"].split()) for i, r in mixed.items()} == {rows_in[k][0]: n for k, n in taken.items() if n}
    for k, (i, t, _) in enumerate(rows_in):
        if taken[k]:
            counts, own = Counter(mixed[i]["text"].split()), Counter(t.split())
            assert all(n <= 2 * own[w] for w, n in counts.items()) and mixed[i]["n_chars"] == len(mixed[i]["text"])
    encode = bin_slack.encoder(ranks=None)
    pieces = Counter()
    for i, r in mixed.items():
        ids = [*encode([r["text"]])[0], 0]
        for piece, (start, length) in enumerate(bin_slack.pieces_of(len(ids), 2048)):
            pieces[i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(step("pack").collect()) == pieces
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == pieces


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
