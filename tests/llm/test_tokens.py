"""Token counts, SentencePiece and packing against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm.bpe import PLAIN, tokenizer
from millrace.llm.packing import pack, packed
from millrace.llm.sentencepiece_codec import codec, encode_and_decode
from millrace.llm.token_counts import token_counts

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_whole_tokens_are_one_token(library):
    whole = tokenizer(JSON, P.PATTERN).whole
    assert len(whole) > 40_000
    for s in random.Random(1).sample(sorted(whole), 500):
        assert library.encode(s, add_special_tokens=False).ids == whole[s]


def test_plain_characters_fall_in_the_same_classes(library):
    pattern = regex.compile(P.PATTERN)
    for c in range(0, 0x10000, 7):
        if not 0xD800 <= c < 0xE000 and PLAIN.fullmatch(chr(c)):
            s = f"a{chr(c)} {chr(c)}a1"
            assert [len(x) for x in pattern.findall(s)] == [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_counts_are_the_librarys(odd, corpus, library):
    for docs in (odd, corpus.limit(150)):
        texts = [r.text or "" for r in docs.select("text").collect()]
        want = sorted((len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for t in texts)
        assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON, P.PATTERN).collect()) == want


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a " + " \n" * 600_000 + "b", "a" * 300_000, "ab" * 200_000 + " " * 1_200_000 + "é", "€" * 100_000, "x 🙂\t" * 100_000])
def test_long_runs_encode_as_in_the_library(library, text):
    bpe, want = tokenizer(JSON, P.PATTERN), library.encode(text, add_special_tokens=False).ids
    assert bpe.count(text) == len(want) and bpe.encode(text).tolist() == want


def test_texts_with_odd_characters_encode_as_in_the_library(library):
    rng, bpe = random.Random(9), tokenizer(JSON, P.PATTERN)
    odd = ["🙂", "€", "→", "א", "ب", "ไ", "क", "ี", "\u180e", "\u2003", "\u0301", "𝒳", "①", "²", "\u200d", "ǅ", "Ⅷ", "'", "'s", "<|endoftext|>"]
    for _ in range(4000):
        s = "".join(rng.choice(odd) if rng.random() < 0.25 else rng.choice(["a", "B", "7", " ", "  ", "\n", ".", "é", " the", "日", "\t"]) for _ in range(rng.randint(0, 40)))
        want = library.encode(s, add_special_tokens=False).ids
        assert bpe.encode(s).tolist() == want and bpe.count(s) == len(want), s


def test_only_the_odd_parts_go_to_the_library():
    bpe = tokenizer(JSON, P.PATTERN)
    text = "one two three four 🙂 five six seven"
    assert list(bpe.parts(text)) == [(True, "one two three four"), (False, " 🙂 five"), (True, " six seven")]
    assert list(bpe.parts("plain")) == [(True, "plain")] and list(bpe.parts("🙂")) == [(False, "🙂")] and bpe.encode("").tolist() == []


def test_pieces_are_the_librarys(odd, corpus, pieces):
    for docs in (odd, corpus.limit(150)):
        found = encode_and_decode(docs, MODEL, ids=True).collect()
        texts = [r.text or "" for r in docs.select("text").collect()]
        ids = [pieces.encode(t, add_eos=True) for t in texts]
        assert sorted(r.ids for r in found) == sorted(ids)
        assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256(pieces.decode(i).encode()).hexdigest() for i in ids)
        assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in found)


def test_random_strings_encode_as_in_the_library(pieces):
    rng, bpe = random.Random(3), codec(MODEL)
    for _ in range(3000):
        s = "".join(rng.choices("aeinst hld  \n▁é日🙂\t.,THE01ß", k=rng.randint(0, 50)))
        assert bpe.encode(s) == pieces.encode(s, add_eos=True), s
        assert bpe.merge("▁" + s.replace(" ", "▁")) == pieces.encode(s) or not s


def check_packed(rows, want, window=1024):
    """Every id once, sequences gapless, of at most a window, padded only if not a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    for i, docs in want.items():
        held = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc.pop(i))
        if len(docs) == 1:
            at = 0
            for start, length, crc, n in held:
                assert start == at and n == len(docs[0])
                assert crc == zlib.crc32(np.array(docs[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(docs[0])
        else:
            assert sum(x[1] for x in held) == sum(map(len, docs))
    assert not by_doc


@pytest.mark.parametrize("shard_tokens", [1_000_000, 3_000])
def test_packing_holds_every_id_once(odd, corpus, library, shard_tokens):
    for docs in (odd, corpus.limit(120)):
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            want[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
        check_packed(pack(docs, JSON, P.PATTERN, shard_tokens=shard_tokens).collect(), want)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * t, 100 * t + 90, (6, 80)) for t in range(1, 9)]
    order = [(t, i) for i in range(6) for t in range(8)]
    docs = [np.append(topics[t][i], 0).astype("<u2") for t, i in order]
    together = defaultdict(list)
    for d, _, _, q, _ in packed(docs, np.ones(1000), 80.0, window=486):
        together[q].append(order[d][0])
    assert sum(len(set(x)) for x in together.values()) <= 12


def test_neighbours_by_terms_that_are_not_the_rarest():
    used, rare, plain = np.resize(np.arange(1, 31), 99), np.arange(1, 31), np.arange(100, 130)
    docs = [used, np.concatenate([rare, plain]), np.arange(200, 260), np.concatenate([plain, np.arange(300, 310)])]
    idf = np.where(np.arange(1000) < 50, 5.0, 1.0)
    rows = packed([np.append(d, 0).astype("<u2") for d in docs], idf, 60.0, window=100)
    assert rows[:3] == [(0, 0, 100, 0, 0), (1, 0, 61, 1, 0), (3, 0, 39, 1, 61)]


def plain_bm25(docs, seed, idf, mean):
    from millrace.llm.packing import B, K1

    return [sum(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(d) - 1) / mean)) for t in set(docs[seed][:-1].tolist()) if (tf := int((d[:-1] == t).sum()))) for d in docs]


@pytest.mark.parametrize("vocabulary", [60, 2000])
def test_scores_are_bm25_of_all_terms(vocabulary):
    from millrace.llm.packing import Shard

    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, vocabulary, rng.integers(0, 90)), 0) for _ in range(40)]
    idf, unused = rng.random(vocabulary) + 0.1, np.ones(40, bool)
    shard = Shard(docs, idf, 45.0)
    for seed in rng.permutation(40):
        unused[seed] = False
        want = np.array(plain_bm25(docs, seed, idf, 45.0)) * unused
        found, score = shard.scores(seed, unused)
        assert found.tolist() == np.flatnonzero(want).tolist() and np.allclose(score, want[found])


@pytest.mark.parametrize("vocabulary", [30, 400])
def test_windows_take_the_best_neighbours_in_turn(vocabulary):
    """The whole choice against a plain version: the seed, then the unused document of the highest BM25, the first of equals."""
    rng = np.random.default_rng(vocabulary)
    docs = [np.append(rng.integers(1, vocabulary, rng.integers(0, 25)), 0).astype("<u2") for _ in range(120)]
    docs += [docs[3], docs[3], docs[5]]
    idf, window = np.ceil(rng.random(vocabulary) * 3), 64
    unused, order, filled, seed = set(range(len(docs))), [], 0, None
    while unused or seed is not None:
        if seed is None:
            seed = min(unused)
            unused.remove(seed)
            order.append(seed)
            filled += len(docs[seed])
        filled %= window
        score, seed_next = plain_bm25(docs, seed, idf, 13.0), None
        while filled and seed_next is None and unused:
            d = max(unused, key=lambda i: (round(score[i], 9), -i))
            if score[d] <= 0:
                break
            unused.remove(d)
            order.append(d)
            filled += len(docs[d])
            if filled > window:
                seed_next = d
            elif filled == window:
                filled = 0
        seed = seed_next
    found = packed(docs, idf, 13.0, window)
    assert list(dict.fromkeys(d for d, *_ in found)) == order


def test_many_short_documents_are_packed_in_time():
    import time

    began = time.perf_counter()
    for docs in ([np.zeros(1, "<u2")] * 1_000_000, [np.array([1, 2 + i % 60_000, 0], "<u2") for i in range(100_000)], [np.array([2 + i, 0], "<u2") for i in range(60_000)]):
        rows = packed(docs, np.ones(1 << 16), 1.0)
        assert sum(r[2] for r in rows) == sum(map(len, docs))
    assert time.perf_counter() - began < 60


def test_documents_about_the_same_thing_meet_in_a_shard(spark):
    words = ["alpha", "river", "engine", "garden", "violin", "copper", "winter", "planet"]
    rows = [(i, f"the one that is in it and of the {words[i % 8]} {words[i % 8]}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shard = {r.doc_id: r.sequence_id >> 32 for r in pack(docs, JSON, P.PATTERN, shard_tokens=2000).collect()}
    assert len(set(shard.values())) > 4
    assert sum(len({shard[i] for i in range(w, 800, 8)}) for w in range(8)) <= 20


def test_empty_tables(none):
    assert token_counts(none, JSON, P.PATTERN).count() == encode_and_decode(none, MODEL).count() == pack(none, JSON, P.PATTERN).count() == 0
