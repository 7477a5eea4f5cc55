import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm.tokenbin import BLOCK, WordEncoder, pack, read_documents, unpack, write_and_read, write_ids
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
RNG = np.random.default_rng(1)
ODD = ["", " ", "A.b  c", "İstanbul.", "the.", "<|endoftext|> x", "é́. é́", "don't's.", "ΑΣ.", "x\ty\x1cz", "日本.", "a.,", "...", "ﬁ.", "1.", "é.\n", "x!\r\ny"]


@pytest.mark.parametrize("ids", [
    np.empty(0, "u8"), np.zeros(1000, "u8"), np.array([2**64 - 1, 0, 5, 2**60, 2**60 - 1, 2**59], "u8"),
    RNG.integers(0, 50000, 100_000).astype("u8"), RNG.zipf(1.3, 50_000).astype("u8"), np.array([7] * 119, "u8"), np.array([1] * 61, "u8"),
    np.concatenate([np.zeros(121, "u8"), [3], np.zeros(240, "u8")]).astype("u8"), *[np.full(241, (1 << w) - 1, "u8") for w in (1, 2, 7, 12, 30, 60)],
])
def test_round_trip(ids):
    payload = pack(ids)
    assert (unpack(payload) == ids).all() and len(unpack(payload)) == len(ids)
    assert (unpack(payload, 1, 1) == ids[BLOCK:2 * BLOCK]).all()


def test_words_are_packed_densely():
    assert len(pack(np.zeros(120_000, "u8"))) < 8_400 and len(pack(np.full(60_000, 1, "u8"))) < 8_200


def test_ids_are_those_of_the_library():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aB. ,'!éÉ日1_\n\tß", k=rng.randint(0, 50))) for _ in range(800)]
    got = WordEncoder(open(PATH).read()).encode(texts)
    assert [list(g) for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_files(documents):
    rows = [*EDGES, *enumerate(ODD, 50)]
    got = write_and_read(documents(rows), PATH, 2).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty(documents):
    assert write_and_read(documents([]), PATH, 2).count() == 0


ADDED = ["<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> x", "<|endoftext|>.", "é<|startoftext|>\u0338", "T49407 t49407",
         "<|endoftext<|endoftext|>|>", "<|endoftext|><|endoftext|>\n", "the. <|startoftext|> The.", "<|endof text|>"]


def test_added_tokens_are_those_of_the_unchanged_library(documents):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = ODD + ADDED + ["".join(rng.choices([*"aB. '!é日\n", *ADDED[:3]], k=rng.randint(0, 20))) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = WordEncoder(open(PATH).read(), added=True)
    assert [list(g) for g in encoder.encode(texts)] == want
    encoder.clear()
    assert [list(g) for g in encoder.encode(texts)] == want
    rows = write_and_read(documents(enumerate(texts)), PATH, 2, added=True).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == {
        k: zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for k, w in enumerate(want)}


def test_rows_of_one_id_spread_over_tasks(documents, spark, tmp_path):
    rng = random.Random(8)
    rows = [(1, " ".join(rng.choices(["the", "of", "and", "was", "is"], k=120)) + str(k)) for k in range(12_000)]
    write_ids(documents(rows).repartition(4), PATH, 2, str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).select("shard").distinct().count() > 1
    got = read_documents(spark, str(tmp_path / "ids")).orderBy("start").collect()
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert len(got) == len(rows) and [r["start"] for r in got] == [0, *ends[:-1]]
