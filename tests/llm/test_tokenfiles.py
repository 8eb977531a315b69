import io
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posttide.llm import queries, tokenfiles

ODD = ["a", "É", "e", "́", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>",
       "<|start", "Σ", "1", "!", "ß", "İ", "가", "\x00", "word", "😀"]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def plain(rows, model, end):
    """(doc_id, start, n_tokens, crc) in order of id, nulls first."""
    whole, out, start = Tokenizer.from_str(model), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def digests(df):
    rows = df.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_words_are_encoded_as_whole_texts(model):
    assert tokenfiles.drops_white_space(model)
    rng, whole = random.Random(1), Tokenizer.from_str(model)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(20))) for _ in range(1500)] + ["x" * 5000, "a b " * 400000]
    coded = tokenfiles.encoder(model)([t.encode() for t in texts])
    for t, pieces in zip(texts, coded):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_marks_after_letters_are_taken_off(model):
    words, whole = tokenfiles.WordIds(model), Tokenizer.from_str(model)
    last = [*LETTERS, "7", *map(chr, range(0xC0, 0x180)), "é", "क़", "x̀"]
    marks = ["###", ".$$$", "&&&", "'", "'''", "’", "~`^|_", "=", "+", "@", ">", "<|endoftext|>", "<", ")\"", "…", "%'"]
    made = [a + b + m for a in ("", "no", "'") for b in last for m in marks]
    known = words.learn([w.encode() for w in made])
    assert all(np.frombuffer(known[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids for w in made)
    words.tokenizer = counted = Counted(words.tokenizer)
    words.learn([f"so{c}{m}".encode() for c in ("é", "s", "ü") for m in ("***", "!%", ".#")])
    assert counted.texts == 4


class Counted:
    """A tokenizer that counts the texts and calls it is given."""

    def __init__(self, inner):
        self.inner, self.texts, self.calls = inner, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.texts, self.calls = self.texts + len(texts), self.calls + 1
        return self.inner.encode_batch_fast(texts, **options)


LETTERS = ["a", "É", "e", "ß", "İ", "가", "Σ", "ς", "ﬁ", "ǆ", "ª", "ʰ", "ก", "ア", "𝒜", "Å", "ᄀ", "ᅡ", "word", "The"]


def test_words_of_letters_are_encoded_together(model):
    words, whole, rng = tokenfiles.WordIds(model), Tokenizer.from_str(model), random.Random(3)
    assert words.ends is not None
    made = sorted({"".join(rng.choices(LETTERS, k=rng.randrange(1, 9))) for _ in range(3000)})
    words.tokenizer = counted = Counted(words.tokenizer)
    known = words.learn([w.encode() for w in made])
    assert all(np.frombuffer(known[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids for w in made)
    plain_words = [f"{a}{b}".encode() for a in ("mi", "no", "pra") for b in ("xu", "vel", "dor", "qui")]
    counted.texts = 0
    words.learn(plain_words)
    assert counted.texts == 1


def test_words_that_come_again_are_not_forgotten(model, monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 20)
    words, whole = tokenfiles.WordIds(model), Tokenizer.from_str(model)
    asked, plainly = [], words.encoded
    monkeypatch.setattr(words, "encoded", lambda some: asked.extend(some) or plainly(some))
    monkeypatch.setattr(words, "encoded_together", lambda some: asked.extend(some) or plainly(some))
    for i in range(40):
        text = f"often x{i}a x{i}b x{i}c often."
        found = b"".join(words.pieces(text.encode()))
        assert np.frombuffer(found, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(words.known) + len(words.before) <= 40
    assert asked.count(b"often") == 1 and asked.count(b"x0a") == 1


def test_texts_of_a_batch_are_learned_together(model):
    words, whole = tokenfiles.WordIds(model), Tokenizer.from_str(model)
    words.tokenizer = counted = Counted(words.tokenizer)
    texts = ["so gut", "", "gut und so", "und x1", "lang " * 300_000, "neu"]
    for t, pieces in zip(texts, words.each([t.encode() for t in texts])):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert counted.calls == 3


def test_files_equal_the_library(spark, documents, model, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", 4000)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "word", "Größe", "<|endoftext|>", "x1"], k=rng.randrange(60))))
            for i in rng.sample(range(-500, 500), 200)]
    rows += [(None, "no id"), (600, None), (601, ""), (602, "  \n "), (603, "long words " * 40000), (604, "é" * 3000)]
    docs = documents(rows, 5).withColumns({c: F.lit(1) for c in ("name", "part", "row", "h", "start", "ids")})
    files = tokenfiles.write_token_files(docs, str(tmp_path / "t"), model, 1, frame_ids=64)
    assert files.count() > 3
    assert digests(tokenfiles.read_token_files(spark, str(tmp_path / "t"))) == plain(rows, model, 1)
    wanted = spark.createDataFrame([(603,), (604,), (604,), (99999,), (rows[0][0],)], "some long")
    some = digests(tokenfiles.read_token_files(spark, str(tmp_path / "t"), wanted))
    assert some == [r for r in plain(rows, model, 1) if r[0] in (603, 604, rows[0][0])]


def test_repeated_ids_and_rows(spark, documents, model, tmp_path):
    rows = [(7, "a b"), (7, "a b"), (7, "c"), (3, "d e f")] * 20
    tokenfiles.write_token_files(documents(rows), str(tmp_path / "t"), model, 1)
    got = digests(tokenfiles.read_token_files(spark, str(tmp_path / "t")))
    expected = plain(rows, model, 1)
    assert sorted((r[0], *r[2:]) for r in got) == sorted((r[0], *r[2:]) for r in expected)
    assert [r[0] for r in got] == [r[0] for r in expected]
    ends = [0, *np.cumsum([r[2] for r in got]).tolist()]
    assert [r[1] for r in got] == ends[:-1]


def test_empty_table(spark, documents, model, tmp_path):
    docs = documents([(1, "x")]).where("doc_id > 5")
    assert tokenfiles.write_token_files(docs, str(tmp_path / "t"), model, 1).count() == 0
    assert tokenfiles.read_token_files(spark, str(tmp_path / "t")).count() == 0


def written(documents, frame_ids=100):
    out = io.BytesIO()
    writer = tokenfiles.FileWriter(out, frame_ids)
    for key, ids in documents:
        data = np.array(ids, "<u4").tobytes()
        writer.add(key, [data[i:i + 28] for i in range(0, len(data), 28)])
    writer.close()
    return out.getvalue()


def test_only_requested_frames_are_read_and_verified():
    docs = [(i, list(range(i, i + 30))) for i in range(50)] + [(None, []), (50, list(range(5000)))]
    data = written(docs)
    whole = np.concatenate([np.array(ids, "<u4") for _, ids in docs])
    plain_reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    frames = tokenfiles.FileReader(io.BytesIO(data), len(data))
    assert plain_reader.read(whole.nbytes) == whole.tobytes()
    listed = frames.documents()
    assert listed.to_pylist() == [{"doc_id": i, "n_tokens": len(ids)} for i, ids in docs]
    assert len(frames.sums) > 10 and frames.frames_read == 0
    assert frames.ids(300, 30) == whole[300:330].tobytes() and frames.frames_read <= 2
    assert frames.ids(0, len(whole)) == whole.tobytes()
    assert frames.ids(len(whole), 0) == b""
    assert max(int(b - a) for a, b in zip(frames.before, frames.ends)) <= 4 * 4 * 100

    place = int(frames.starts[3]) + 12
    damaged = data[:place] + bytes([data[place] ^ 255]) + data[place + 1:]
    broken = tokenfiles.FileReader(io.BytesIO(damaged), len(damaged))
    assert broken.ids(0, 30) == whole[:30].tobytes()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(0, len(whole))
    with pytest.raises(ValueError):
        tokenfiles.FileReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_checksum_alone_finds_a_changed_frame():
    data = written([(1, [5] * 300)])
    at = len(data) - 9 - 4
    changed = data[:at] + b"\0\0\0\0" + data[at + 4:]
    with pytest.raises(ValueError, match="damaged"):
        reader = tokenfiles.FileReader(io.BytesIO(changed), len(changed))
        reader.ids(0, 300)


def test_full_files_are_ended(spark, documents, model, tmp_path):
    rows = [(i, "some words here") for i in range(40)]
    files = tokenfiles.write_token_files(documents(rows).coalesce(1), str(tmp_path / "t"), model, 1, file_ids=8)
    assert files.count() > 15 and files.where("number > 0").count() > 0
    assert digests(tokenfiles.read_token_files(spark, str(tmp_path / "t"))) == plain(rows, model, 1)
    writer = tokenfiles.FileWriter(io.BytesIO())
    assert not writer.full()
    writer.lengths = [0] * tokenfiles.FILE_DOCUMENTS
    assert writer.full()


def test_query_equals_the_library(spark, sf_dir, model):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_token_files(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == plain(rows, model, 1)


def test_packed_list_keeps_null_ids():
    data = written([(None, [1]), (2, [3])])
    assert tokenfiles.FileReader(io.BytesIO(data), len(data)).documents().column("doc_id").type == pa.int64()


def test_words_in_other_case_are_learned_once(model):
    words, whole = tokenfiles.WordIds(model), Tokenizer.from_str(model)
    texts = ["Gut gut GUT guT", "DAS Größte das größte", "J\u030c H\u0331x T\u0308 I\u0307 ǰ j\u030c", "<|ENDOFTEXT|> Gut",
             "a<|endoftext|>B <|EndOfText|>", "\u212a \u0130X \u01c5A A\u0345 K\u0338", "ΑΣ AΣB Σ"]
    for t, pieces in zip(texts, words.each([t.encode() for t in texts])):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    words = tokenfiles.WordIds(model)
    words.learn(words.words(b"Gut gut GUT guT. gUt"))
    assert set(words.known) == {b"gut", b"gut.", b"."}
    assert not tokenfiles.lowers_letters(model.replace('"Lowercase"', '"NFD"'))


def test_words_of_plain_letters_need_no_patterns(model):
    words, whole, rng = tokenfiles.WordIds(model), Tokenizer.from_str(model), random.Random(5)
    words.tokenizer.whole = counted = Counted(words.tokenizer.whole)
    letters = [c.decode() for c in sorted(tokenfiles.LATIN)] + list("abcxyzAEIOU")
    made = letters + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(3000)]
    known = words.learn([w.encode() for w in made])
    assert all(np.frombuffer(known[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids for w in made)
    assert counted.texts == 0
    for changed in (('"Lowercase"', '"NFD"'), ('"invert": true', '"invert": false'), ('"use_regex": false', '"use_regex": true')):
        other = json.dumps(json.loads(model)).replace(*changed)
        assert other != json.dumps(json.loads(model)) and tokenfiles.ShortWay(other).short is None


def test_a_word_of_many_texts_is_looked_up_once(model, monkeypatch):
    words, whole, asked = tokenfiles.WordIds(model), Tokenizer.from_str(model), []
    ids = words.ids
    monkeypatch.setattr(words, "ids", lambda some: asked.extend(some) or ids(some))
    texts = ["Gut so gut", " gut\n", "", "so", "\x80 so"] * 50
    for t, pieces in zip(texts, words.each([t.encode() for t in texts])):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert sorted(w for w in asked if w) == [b"gut", b"so", "\x80".encode()]
    broken = next(words.each([b"so \xff\xfe gut"]))
    assert b"".join(broken) == words.encoded([b"so \xff\xfe gut"])[0]


def test_files_are_listed_and_read_in_one_python_step(spark, documents, model, tmp_path):
    most = spark.conf.get(tokenfiles.BATCH_KEY)
    tokenfiles.write_token_files(documents([(1, "a b"), (2, "c")]), str(tmp_path / "t"), model, 1)
    assert spark.conf.get(tokenfiles.BATCH_KEY) == most
    found = tokenfiles.read_token_files(spark, str(tmp_path / "t"))
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    assert digests(found) == plain([(1, "a b"), (2, "c")], model, 1)
