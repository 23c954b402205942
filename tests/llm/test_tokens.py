"""Token shards: the tokenizer's own ids for whole texts, exact round trips, starts and retries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliary.llm import tokens

SCHEMA = "text string, doc_id long, start string"
PATH = tokens.default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows):
    out, start = [], 0
    for d, ids in sorted(((d, ids_of(t)) for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0, len(x[1]))):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, rows, folder, **options):
    frame = spark.createDataFrame([(t, d, "x") for d, t in rows], SCHEMA)
    manifest = tokens.write_shards(frame, str(folder), **options)
    found = tokens.read_shards(manifest, str(folder))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted(map(tuple, found.collect()), key=lambda r: r[1]), manifest


def test_pieces_give_the_ids_of_whole_texts():
    draw = random.Random(11)
    bits = ["a", "The", "l'été", " ", "  ", "\n", "\t", " ", "　", "\u0085", "\x1c", "\x00", "12", "3.5", "'s", "!", "été", "ñ", "日本",
            "<|endoftext|>", "​", " ", "é", "à", "É ", " É", "…", "\r\n", "😀", " ", "ꀀ", "ê", "É", "©"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 60))) for _ in range(3000)] + ["", " ", "a b", " a", "a "]
    found = dict(tokens.encoded(pa.array(texts), PATH))
    for i, text in enumerate(texts):
        assert found[i].tolist() == ids_of(text), repr(text)


def test_round_trip(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.randrange(-500, 10_000), " ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(0, 80)))) for _ in range(900)]
    rows += [(20_000, "long " * 60_000), (5, "same"), (5, "same"), (6, None), (7, ""), (None, "no id"), (None, None)]
    found, manifest = stored(spark, rows, tmp_path, shard_chars=40_000)
    assert found == expected(rows) and manifest.count() > 4
    shard = manifest.orderBy("shard").first()
    reader = tokens.Reader(str(tmp_path), shard.file)
    known = dict((d, t) for d, t in rows)
    single = next(i for i in reader.ids if sum(d == i for d, _ in rows) == 1)
    assert reader.find(single).tolist() == ids_of(known[single])


def test_few_and_none(spark, tmp_path):
    rows = [(3, "b"), (1, "a b")]
    assert stored(spark, rows, tmp_path / "few")[0] == expected(rows)
    assert stored(spark, [], tmp_path / "none")[0] == []


def test_another_dictionary_is_refused(spark, tmp_path):
    _, manifest = stored(spark, [(i, f"word{i} " * 50) for i in range(200)], tmp_path)
    name = next(tmp_path.glob("*.zdict"))
    name.write_bytes(name.read_bytes() + b"x")
    with pytest.raises(ValueError):
        tokens.Reader(str(tmp_path), manifest.first().file)
