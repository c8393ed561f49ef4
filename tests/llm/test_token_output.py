import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from refrain.llm import range_coder, token_output
from refrain.llm.token_output import CachedTokenizer, public_tokenizer, read_token_files, segment_ids, token_files, write_token_files
from tests.llm.tables import documents, empty, mixed_texts


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 49_408])
def test_coder_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    blocks = [rng.integers(0, vocabulary, n) for n in (0, 1, 2, 4096, 4095, 300, 1)]
    blocks += [np.full(4096, vocabulary - 1), np.arange(4096) % min(vocabulary, 50), (rng.zipf(1.3, 4096) % vocabulary)]
    payloads = range_coder.encode_blocks(blocks, vocabulary)
    decoded = range_coder.decode_blocks(payloads, [len(b) for b in blocks], vocabulary)
    assert all((a == b).all() for a, b in zip(blocks, decoded, strict=True))
    alone = range_coder.decode_blocks(payloads[3:4], [4096], vocabulary)
    assert (alone[0] == blocks[3]).all()


def test_model_learns():
    repeated = range_coder.encode_blocks([np.arange(4096) % 50], 49_408)[0]
    noise = range_coder.encode_blocks([np.random.default_rng(0).integers(0, 49_408, 4096)], 49_408)[0]
    assert len(repeated) < 400 and len(noise) < 8192 * 1.05


def test_cached_pieces_equal_whole_texts():
    path = public_tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["Don't stop... WON'T!!", "İstanbul. ÀÉ, straße; x\u0301. a.\u0301", "a<|endoftext|>.b <|ENDOFTEXT|> <|endoftext|.", "1,234.5% #tag|pipe ~x~ 日本語。 ٣٤", "tab\tand\u00a0nbsp\x85next\r\nx", "'s 't ''s it's.", "e\u0301cole, E\u0301.", "ΑΣ. ΣΑΣ"]
    texts = odd + [t or "" for _, t in mixed_texts()]
    cached = CachedTokenizer(path)
    for _ in range(2):
        for text, ids in zip(texts, cached.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_lower_case_words_are_split_at_spaces_alone():
    """Every letter of ASCII and Latin-1, and marks after it, go through the plain tokenizer, not one by one through the whole one."""
    path = public_tokenizer("word_bpe_49k.json")
    whole, cached, singly = Tokenizer.from_file(path), CachedTokenizer(path), []
    one = cached._ids
    cached._ids = lambda text: singly.append(text) or one(text)
    letters = [chr(c) for c in (*range(97, 123), *range(223, 247), *range(248, 256))]
    words = [a + b + c for a in letters[::7] for b in letters for c in letters[::11]] + ["stra\xdfe", "erzu\xdf"]
    texts = [" ".join(words), " ".join(f"{w}{m}" for w, m in zip(words, [".", ",", "?!", "..."] * len(words), strict=False))]
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert not set(singly) & set(words)


def test_cut_pieces_equal_whole_texts():
    """Hostile mixes of letters, marks, white space, combining marks and special tokens."""
    path = public_tokenizer("word_bpe_49k.json")
    whole, cached, rng = Tokenizer.from_file(path), CachedTokenizer(path), np.random.default_rng(7)
    parts = ["a", "B", "\xdf", "\xc9", "\xd7", "\xf7", "\xb5", "\xaa", "\xa0", "\x85", "\xad", "7", "\u0663", ".", ",", "!", "|", "#", "?", "'", "s", "-", "<", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", " ", "  ", "\n", "\t", "\r", "\u0301", "\u030c", "J", "\u0130", "\u2019", "\u2028", "\u65e5", "\U0001f600", "\0"]
    texts = ["", " ", *("".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3000)), ""]
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert cached.encode([]) == [] and [len(x) for x in cached.encode([""])] == [0]


def test_marks_do_not_multiply_words():
    cached = CachedTokenizer(public_tokenizer("word_bpe_49k.json"))
    cached.encode(["Word word, WORD. word; word: word! word? word... \xc9t\xe9, \xe9t\xe9."])
    assert len(cached.cache) <= 2 + 8


def test_words_in_use_outlive_a_full_cache():
    cached, learnt = CachedTokenizer(public_tokenizer("word_bpe_49k.json")), []
    cached.MOST, one = 100, cached._ids
    cached._ids = lambda text: learnt.append(text) or one(text)
    for i in range(40):
        cached.encode([f"in-use {' '.join(f'{i}-{k}' for k in range(20))}"])
    assert learnt.count("in-use") == 1 and len(cached.cache) <= 100


def test_a_few_blocks_more_need_no_run_of_their_own(monkeypatch):
    runs, encode = [], range_coder._encode
    monkeypatch.setattr(range_coder, "_encode", lambda blocks, vocabulary: runs.append(len(blocks)) or encode(blocks, vocabulary))
    blocks = [np.arange(3)] * (range_coder.LANES + 16)
    payloads = range_coder.encode_blocks(blocks, 300)
    assert runs == [range_coder.LANES + 16] and len(payloads) == len(blocks)
    decoded = range_coder.decode_blocks(payloads, [3] * len(blocks), 300)
    assert all((a == b).all() for a, b in zip(blocks, decoded, strict=True))


def test_long_texts_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(token_output, "SLICE", 40)
    texts = pa.array(["a" * 30, "b" * 10, "c", "d" * 100, "", "e"])
    assert list(token_output._slices(texts)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(token_output._slices(pa.array([], pa.string()))) == []


def test_documents(spark):
    texts = [t for t in mixed_texts() if t[0] not in (40, 41)]
    plain = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    want, start = {}, 0
    for i, text in sorted(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    df = token_files(documents(spark, texts).repartition(5))
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == want


def test_null_ids_come_last_and_repeats_stay(spark):
    rows = token_files(documents(spark, [(None, "b"), (2, "a"), (2, "a"), (1, None)])).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(1, 0, 1), (2, 1, 2), (2, 3, 2), (None, 5, 2)]


def test_files_and_checksums(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(documents(spark, {1: "one two three", 2: "four"}), path, public_tokenizer("word_bpe_49k.json"), 1)
    row = spark.read.parquet(path).first().asDict()
    assert segment_ids(row)[-1] == 1 and row["n_tokens"] == len(segment_ids(row))
    with pytest.raises(ValueError, match="checksum"):
        segment_ids(row | {"block_crc32": [row["block_crc32"][0] ^ 1]})
    assert read_token_files(spark, path).count() == 2


def test_empty(spark):
    assert token_files(empty(spark)).count() == 0
