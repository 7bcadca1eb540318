"""Collocations: phrases that occur often, mined in shards and counted exactly (SON), scored by their weakest cut.

A phrase is a run of words within a piece of a text, pieces being parted by punctuation and line breaks.
What occurs SUPPORT times in all occurs at least SUPPORT / SHARDS times in one of SHARDS shards of the
documents. So a first pass for each length counts the phrases of each shard, by a 64-bit hash, and keeps
those that are frequent there; a phrase is only looked at if both shorter ones that it overlaps in all but
a word were kept. The union over the shards is a bitmap of bounded size for each length; a last pass counts
what the bitmaps know, by its words, over all documents, and what falls short goes. Hashes that meet and
bits that many share only let more through to the exact count. A shard is no task: all tasks mine all
shards, each adds up what it reads before it is shuffled, and a shard's count of a phrase is one row of the
shuffle. (With a support as small as 10, shards of one task each would keep every phrase.)

Words are cut and hashed whole batches at a time on the bytes of the texts. Null texts are empty; a null
language is `und`. Texts of any length are read whole, a piece at a time at least. Documents that repeat count
each time. Ties go to the phrase that is smaller in UTF-8. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.llm.common import n_shuffled, saved, with_facts, written

SUPPORT, MOST_WORDS, COVERED, TOP = 10, 3, 50, 2_000
#: Shards that the documents are dealt to; local support is SUPPORT / SHARDS, and has to stay above 1 to weed anything.
SHARDS = 2
#: Bits of a hash that a shard's number takes.
SHARD_BITS = 4
#: Bits of the bitmap of candidates, as a power of 2, and bits for each candidate.
MOST_BITS, BITS_EACH = 27, 16
#: Bytes of text that are cut at once, and phrases whose words a task holds before it gives them on.
CHUNK, MOST_TOLD = 1 << 20, 800_000
#: Rows of a batch that is given on.
ROWS = 50_000

U = np.uint64
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, "uint8")
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWERED = np.frombuffer(_LOWER, "uint8")
_dice = np.random.default_rng(11)
#: For two independent hashes: a number for each byte, small and capital letters alike, and an odd factor.
_OF_BYTE = [_dice.integers(0, 2**64, 256, "uint64")[list(_LOWER)] for _ in range(2)]
_FACTOR = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, factor: int) -> np.ndarray:
    """1, factor, factor^2, ... modulo 2^64."""
    if len(_powers.get(factor, ())) < n:
        out = np.full(max(n, CHUNK + CHUNK // 4), factor, "uint64")
        out[0] = 1
        _powers[factor] = np.cumprod(out, dtype="uint64")
    return _powers[factor][:n]


class Words:
    """The words of a chunk of texts: where they start and end, their text, their piece, and hashes of their phrases."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = data
        kind = _KIND[data]
        inside = kind == 0
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(bounds, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[self.starts] + self.text

    def hashes(self, which: int) -> np.ndarray:
        """A hash of each word: the sum of its bytes' numbers times powers, brought back to its start."""
        n, f = len(self.data), _FACTOR[which]
        sums = np.zeros(n + 1, "uint64")
        np.cumsum(_OF_BYTE[which][self.data] * powers(n, f), out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * powers(n, pow(f, -1, 2**64))[self.starts])

    def phrases(self, most: int, seeds: np.ndarray, which: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word, hash) of all phrases of 1 to most words; seeds: a number for each text's language."""
        word = self.hashes(which)
        so_far, first = mixed(word + seeds[self.text]), np.arange(len(word))
        yield 1, first, so_far
        for k in range(2, most + 1):
            fits = first + k - 1 < len(word)
            first, so_far = first[fits], so_far[fits]
            fits = self.piece[first] == self.piece[first + k - 1]
            first, so_far = first[fits], so_far[fits]
            so_far = mixed(so_far * U(3) + word[first + k - 1])
            yield k, first, so_far

    def phrase(self, first: int, k: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + k)).translate(_LOWER).decode("utf-8", "replace")

    def texts(self, first: np.ndarray, k: int) -> pa.Array:
        """Phrases as text: bytes of the chunk as they stand, put together at once, or word by word where more than a blank is between words."""
        plain = np.ones(len(first), bool)
        for i in range(k - 1):
            end = self.ends[first + i]
            plain &= (self.starts[first + i + 1] == end + 1) & (self.data[end] == 32)
        start, size = self.starts[first[plain]], self.ends[first[plain] + k - 1] - self.starts[first[plain]]
        offsets = np.concatenate([[0], np.cumsum(size)])
        taken = self.data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
        out = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(_LOWERED[taken])])
        if plain.all():
            return out
        others = pa.array([self.phrase(int(i), k) for i in first[~plain]], pa.string())
        return pa.concat_arrays([out, others]).take(pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds of the texts in them) of a batch's text column, cut only between texts or pieces."""
    column = batch.column("text")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return
    bounds = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
    data, bounds = np.frombuffer(data, "uint8")[bounds[0] : bounds[-1]], bounds - bounds[0]
    a = 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        if b < len(data):
            text_end = int(bounds[np.searchsorted(bounds, b)])
            breaks = np.flatnonzero(_KIND[data[b:text_end]] == 2)
            b = b + int(breaks[0]) + 1 if len(breaks) else text_end
        yield data[a:b], np.clip(bounds, a, b) - a
        a = b


def languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, and for each text its language's place there and number."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    place = coded.indices.to_numpy(zero_copy_only=False).astype("int64")
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], "uint64")
    return names, place, seeds[place] if len(names) else np.zeros(0, "uint64")


def known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap knows."""
    bit = h >> U(64 - (64 * len(bits) - 1).bit_length())
    return (bits[(bit >> U(6)).astype("int64")] >> (bit & U(63))) & U(1) == 1


def local_counts(batches: Iterator[pa.RecordBatch], k: int, shorter: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, n): occurrences of phrases of k words, by hash and shard, added up a chunk at a time; shorter: the bitmap of phrases of k - 1 words."""
    for batch in batches:
        _, _, seeds = languages(batch)
        shard = batch.column("shard").to_numpy(zero_copy_only=False).astype("uint64")
        for data, bounds in chunks(batch):
            words = Words(data, bounds)
            likely = np.zeros(len(words.starts) + 1, bool)
            for n, first, h in words.phrases(k, seeds, 0):
                if n == k - 1:
                    likely[first] = known(h, shorter)
            if k > 1:
                both = likely[first] & likely[first + 1]
                first, h = first[both], h[both]
            keys, n = np.unique((h >> U(SHARD_BITS) << U(SHARD_BITS)) | shard[words.text[first]], return_counts=True)
            for i in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS].view("int64")), pa.array(n[i : i + ROWS])], ["key", "n"])


class Told:
    """Counts of phrases by their words; a phrase's words are put together once, when its hashes are new."""

    def __init__(self) -> None:
        self.keys, self.checks, self.counts, self.at = (np.zeros(0, t) for t in ("uint64", "uint64", "int64", "int64"))
        self.parts: list[tuple[pa.Array, np.ndarray, int]] = []  # texts, languages, words
        self.rows: list[tuple[str, int, str | None, int]] = []
        self.langs: dict[str, int] = {}
        self.n = 0

    def add(self, words: Words, langs: list[str], place: np.ndarray, k: int, first: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Adds occurrences: phrases of k words from `first` on, with two hashes. Where the first meets and the second doesn't, the occurrence is told apart."""
        keys, lead, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        name = lambda i: (langs[place[words.text[first[i]]]], k, words.phrase(int(first[i]), k))
        for i in np.flatnonzero(check != check[lead][inverse]):
            self.rows.append((*name(i), 1))
            n[inverse[i]] -= 1
        to = np.searchsorted(self.keys, keys)
        at = np.minimum(to, max(0, len(self.keys) - 1))
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        for i in np.flatnonzero(old):
            if self.checks[at[i]] != check[lead[i]]:
                self.rows.append((*name(lead[i]), int(n[i])))
                n[i] = 0
        self.counts[at[old]] += n[old]
        new = ~old
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], "int32")
        fresh = first[lead[new]]
        self.parts.append((words.texts(fresh, k), codes[place[words.text[fresh]]], k))
        insert = lambda held, more: np.insert(held, to[new], more)
        self.keys, self.checks, self.counts, self.at = insert(self.keys, keys[new]), insert(self.checks, check[lead[new]]), insert(self.counts, n[new]), insert(self.at, self.n + np.arange(len(fresh)))
        self.n += len(fresh)

    def given(self) -> Iterator[pa.RecordBatch]:
        """All rows so far, which are forgotten then."""
        counts = np.zeros(self.n, "int64")
        counts[self.at] = self.counts
        names, parts, rows, done = pa.array(list(self.langs), pa.string()), self.parts, self.rows, 0
        self.__init__()
        for texts, codes, k in parts:
            for i in range(0, len(texts), ROWS):
                some, own = texts[i : i + ROWS], codes[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(np.full(len(own), k, "int32")), some, pa.array(counts[done + i : done + i + len(own)])], schema=_TOLD)
            done += len(texts)
        for i in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + ROWS], strict=True), _TOLD, strict=True)], schema=_TOLD)


_TOLD = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def exact_counts(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, k, phrase, n): occurrences of the phrases that the bitmaps know, one for each length; with k 0 and no phrase, a language's words."""
    told, most = Told(), len(bitmaps)
    for batch in batches:
        langs, place, seeds = languages(batch)
        n_words = np.zeros(len(langs), "int64")
        for data, bounds in chunks(batch):
            words = Words(data, bounds)
            n_words += np.bincount(place[words.text], minlength=len(langs))
            for (k, first, h), (_, _, check) in zip(words.phrases(most, seeds, 0), words.phrases(most, seeds, 1), strict=True):
                hit = known(h, bitmaps[k - 1])
                told.add(words, langs, place, k, first[hit], h[hit], check[hit])
            if told.n > MOST_TOLD:
                yield from told.given()
        told.rows += [(lang, 0, None, int(n)) for lang, n in zip(langs, n_words, strict=True) if n]
    yield from told.given()


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits over hashes (key), by their highest bits; at most 2^(bits - 6) numbers reach the driver."""
    at = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
    got = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "int64")
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view("uint64")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, most: int = MOST_WORDS, shards: int = SHARDS) -> DataFrame:
    """(lang, k, phrase, a): all phrases of 1 to most words that occur a >= support times, and with k 0 the words of each language."""
    if not 1 <= shards <= 1 << SHARD_BITS:
        raise ValueError(f"shards must be 1 to {1 << SHARD_BITS}")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    context, held = docs.sparkSession.sparkContext, []
    for k in range(1, most + 1):
        shorter = held[-1] if held else None
        local = texts.mapInArrow(lambda batches, k=k, shorter=shorter: local_counts(batches, k, shorter and shorter.value), "key long, n long")
        local = local.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= -(-support // shards))
        keys = saved(local.select(F.expr(f"key & ~{(1 << SHARD_BITS) - 1}L").alias("key")).distinct())
        bits = min(MOST_BITS, max(12, (BITS_EACH * keys.count()).bit_length()))
        held.append(context.broadcast(bitmap(keys, bits)))  # at most 2^MOST_BITS bits
    found = texts.mapInArrow(lambda batches: exact_counts(batches, [b.value for b in held]), "lang string, k int, phrase string, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= support) | (F.col("k") == 0))


def _run(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of 2 words or more, by the cut with the lowest score; frequent is saved."""
    whole = frequent.where("k >= 2").select("lang", "phrase", "k", "a", F.split("phrase", " ").alias("w"))
    cuts = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _run(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _run(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = written(cuts)
    # a part of a frequent phrase is frequent; frequent words are parts of many
    for part, count in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy(F.col("lang").alias("of"), F.col(part).alias("part")).agg(F.count("*").alias("uses"))
        facts = uses.join(frequent.hint("merge"), (F.col("of") == F.col("lang")) & (F.col("part") == F.col("phrase"))).select("lang", F.col("phrase").alias(part), "uses", F.col("a").alias(count))
        cuts = with_facts(cuts, written(facts), ["lang", part], "uses", [count])
    wide = "cast({} as decimal(19,0)) * cast({} as decimal(19,0))"  # exact beyond 64 bits
    score = F.expr(f"{wide.format('a', 'a')} * cast(1000000 as decimal(7,0)) div ({wide.format('l', 'r')})")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST_WORDS, shards: int = SHARDS, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language in docs (doc_id, lang, text).

    A candidate goes if a longer one that holds it occurs at least `covered` percent as often.
    """
    frequent = saved(frequent_phrases(docs, support, most, shards))
    longer = frequent.where("k >= 3").select("lang", "k", "a", F.split("phrase", " ").alias("w"))
    longer = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)))
    longer = longer.groupBy(F.col("lang").alias("of"), _run(F.col("w"), F.col("first"), F.col("n")).alias("part")).agg(F.max("a").alias("most"))
    rows = scored(frequent).join(longer.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each of many random parts of a language, then of a few, then of the language
    for parts in (n_shuffled(docs.sparkSession), 4):
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = frequent.where("k = 0").select(F.col("lang").alias("_of"), F.col("a").alias("n"))
    rows = rows.join(words.hint("merge"), F.col("lang") == F.col("_of"))
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: Phrases as lists of a piece's words, counted outright.
SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY 1),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM worded, range(1, {MOST_WORDS + 1}) t(k) WHERE len(w) >= k),
frequent AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
cuts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM frequent WHERE k >= 2),
cut_scores AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, 1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM frequent f WHERE f.k = 3 AND f.lang = b.lang AND len(string_split(b.phrase, ' ')) = 2 AND 100 * f.a >= {COVERED} * b.a
  AND (starts_with(f.phrase, b.phrase || ' ') OR ends_with(f.phrase, ' ' || b.phrase))))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""
