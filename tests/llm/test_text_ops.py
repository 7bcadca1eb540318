"""Phrase mining, the Merkle log and the BPE transducer against plain loops and the tokenizer library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionforge.llm import bpe_transducer as bpe
from sessionforge.llm import merkle_log as merkle
from sessionforge.llm import phrase_mining as mining

DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank int, score string"


def docs_of(spark, rows):
    """Documents (doc_id, source, lang, n_chars, text) with two more columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)


# phrases


def plain_collocations(rows, support, most, covered, top):
    f, n = Counter(), Counter()
    for _, _, lang, _, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < support:
            continue
        longer = [b for (la, v), b in f.items() if la == lang and len(v) > len(w) and b >= support and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:top]))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "A", "b", "ca", "é", "É", "ß", "x y", "d1", " "]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", " ! "]
    out = []
    for i in range(n):
        words_of = [rng.choice(words[: rng.choice([2, 4, 10])]) + rng.choice(seps[: rng.choice([1, 3, 9])]) for _ in range(rng.randrange(40))]
        out.append((rng.choice([i, 1, None]), "s", rng.choice(["en", "fr", None, "und"]), 1, rng.choice(["".join(words_of)] * 8 + ["", None, " . ", "a b " * 300])))
    return out


@pytest.mark.parametrize(("seed", "support", "most", "shards", "top"), [(1, 10, 3, 2, 2000), (2, 4, 4, 4, 5), (3, 1, 2, 1, 3)])
def test_collocations_against_a_plain_loop(spark, monkeypatch, seed, support, most, shards, top):
    monkeypatch.setattr(mining, "CHUNK", 256)  # texts are cut between pieces
    monkeypatch.setattr(mining, "MOST_TOLD", 50)
    rows = texts(seed, 60)
    got = mining.collocations(docs_of(spark, rows).repartition(3), support, most, shards, top=top)
    want = plain_collocations(rows, support, most, mining.COVERED, top)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_phrases_whose_hashes_meet_are_told_apart():
    data = np.frombuffer(b"one two one two three", "uint8")
    words = mining.Words(data, np.array([0, len(data)]))
    told, first = mining.Told(), np.arange(5)
    for _ in range(2):  # all five words meet in the first hash, not in the second
        told.add(words, ["en"], np.array([0]), 1, first, np.zeros(5, "uint64"), words.hashes(1))
    counts = Counter()
    for batch in told.given():
        for r in batch.to_pylist():
            counts[r["phrase"]] += r["n"]
    assert {k: v for k, v in counts.items() if v} == {"one": 4, "two": 4, "three": 2}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    frequent = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], "lang string, k int, phrase string, a long").cache()
    assert [r["score"] for r in mining.scored(frequent).collect()] == [1_000_000 * (big - 2) ** 2 // (big * (big - 1))]


def test_no_documents_give_no_phrases(spark):
    assert mining.collocations(docs_of(spark, [])).collect() == []
    assert mining.collocations(docs_of(spark, [(1, None, None, None, None), (2, None, "en", None, "")])).collect() == []


# Merkle log


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and for each leaf its siblings as (side, digest), side 0 left, 1 right, 2 none."""
    proofs, level, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_members = [], []
        for i in range(0, len(level), 2):
            run, of = level[i : i + 2], members[i : i + 2]
            for side, own in enumerate(of):
                for m in own:
                    proofs[m].append((2, None) if len(run) == 1 else (1 - side, run[1 - side]))
            up.append(digest(*run))
            up_members.append([m for own in of for m in own])
        level, members = up, up_members
    return level[0], proofs


def plain_proofs(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0], digest(*map(field, r)), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {lang: plain_tree([x[1] for x in by_lang[lang]]) for lang in langs}
    root, tops = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (doc_id, leaf, r), proof in zip(by_lang[lang], trees[lang][1], strict=True):
            h = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[3] is not None:
                h = digest(*map(field, (r[0], r[1], r[2], r[3] + 1, r[4])))
            for side, other in proof + top:
                h = digest(h) if side == 2 else digest(h, other) if side == 1 else digest(other, h)
            out.append((doc_id, leaf, trees[lang][0], root, digest(*[o for _, o in proof + top if o]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 7])
def test_proofs_against_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rng, rows = random.Random(bits), []
    for lang, n in ((None, 1), ("", 2), ("a", 3), ("b", 5), ("z", 4), ("é", 17), ("en", 33)):
        rows += [(rng.choice([None, 2**60 + 1, -4, *range(3 * n)]), rng.choice(["s", None, ""]), lang, rng.choice([None, 0, 2**63 - 1]), rng.choice([None, "", "é-:", "x" * 5000])) for _ in range(n)]
    rows.append(rows[-1])
    got = merkle.proofs(docs_of(spark, rows)).collect()
    want = plain_proofs(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_the_log_is_written_in_postorder(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = [(i, None, lang, 1, "t") for lang, n in (("a", 1), ("b", 6), ("c", 21), ("d", 16)) for i in range(n)]
    lower, _, _ = merkle.manifest(docs_of(spark, rows))
    got = {}
    for r in merkle.log(lower).collect():
        got.setdefault(r["grp"], []).append((r["at"], r["level"], r["digest"]))

    def plain(leaves, height):
        """Digests in the order in which a depth-first walk leaves the nodes."""
        if height == 0:
            return [(0, leaves[0])]
        half = 1 << (height - 1)
        left = plain(leaves[:half], height - 1)
        right = plain(leaves[half:], height - 1) if len(leaves) > half else []
        return left + right + [(height, digest(*[side[-1][1] for side in (left, right) if side]))]

    leaf = {(r[2], r[0]): digest(*(f"{len(str(v))}:{v}" if v is not None else "-" for v in r)) for r in rows}
    for lang, n in (("a", 1), ("b", 6), ("c", 21), ("d", 16)):
        want = plain([leaf[lang, i] for i in range(n)], (n - 1).bit_length())
        assert sorted(got["=" + lang]) == [(at, level, d) for at, (level, d) in enumerate(want)]


def test_no_documents_give_no_proofs(spark):
    assert merkle.proofs(docs_of(spark, [])).collect() == []


# tokens


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, bpe.Matcher(), most_matches=50)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab 's'tre\n\t1.é中՘ \x1c<|endoftext|>", max_size=60))
def test_ids_are_the_librarys(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert b"".join(bpe.decoded(ids, encoder.transducer.merges.bytes_of)) == text.encode()


def test_bytes_are_merged_as_the_library_merges_them(ranks, library):
    rng, tokens = random.Random(4), list(ranks)
    few = bpe.Transducer(ranks, most_states=40)  # states are forgotten and made again
    for i in range(3000):
        data = bytes(rng.choice(b"abetnos ") for _ in range(rng.randrange(1, 20))) if i % 3 == 0 else b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))) if i % 3 == 1 else bytes(rng.randrange(256) for _ in range(rng.randrange(1, 10)))
        assert few.encode(data) == library._core_bpe.encode_single_piece(data)
        assert len(few.states) <= 40
    for byte in b"a -=":
        for n in (1, 2, 63, 64, 65, 1000):
            assert few.encode(bytes([byte]) * n) == library._core_bpe.encode_single_piece(bytes([byte]) * n)


def test_tokens_wait_no_longer_than_the_longest_token(ranks):
    t, longest = bpe.Transducer(ranks), max(map(len, ranks))
    data = (b"international" * 400 + b"=" * 3000 + b"thethethe" * 300)[:9000]
    number = sent = 0
    for i, byte in enumerate(data):
        number, sure = t.moves.get(number << 8 | byte) or t.step(number, byte)
        sent += sum(len(t.merges.bytes_of[x]) for x in sure)
        assert i + 1 - sent <= 2 * longest


@settings(max_examples=300, deadline=None)
@given(data=st.binary(max_size=40) | st.text(max_size=12).map(lambda t: t.encode()), cuts=st.lists(st.integers(0, 40)))
def test_streamed_characters_are_those_of_the_whole(data, cuts):
    machine, out, at = bpe.Utf8(), "", 0
    for cut in [*sorted(c for c in cuts if c < len(data)), len(data)]:
        part = machine.feed(data[at:cut])
        assert len(machine.held) <= 3
        out, at = out + part.decode("utf-8", "replace"), cut
    assert out + machine.end().decode("utf-8", "replace") == data.decode("utf-8", "replace")


def test_documents_there_and_back(spark, library):
    rows = [(1, None, None, None, "Hello, wörld! it's"), (1, None, None, None, ""), (None, None, None, None, None), (2**60 + 1, None, None, None, "x" * 70_000 + " 中文 " * 2_000), (3, None, None, None, "<|endoftext|>퟿\U0010ffff")]
    docs = docs_of(spark, rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[4] or "")
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r[4] or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r[0], r[4] or "") for r in rows), key=str)
    assert bpe.round_trip(docs.where("doc_id < 0")).collect() == []
    assert bpe.decode(docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))).where("text is not null").count() == 0


def test_a_vocabulary_without_all_bytes_is_an_error():
    with pytest.raises(ValueError, match="bytes without a token"):
        bpe.Merges({b"a": 0})
