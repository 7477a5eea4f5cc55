import gc
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken

from pairloom.llm.bpe import Coder, encode_decode, read_ranks
from tests.llm.conftest import EDGES, by_id, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", "  ", " a  b ", "a\t b", "x\x1c!\x1cy  z", "a" * 3000, "-" * 500, "é" * 700, "日本語テキスト", " x  y\n\n z", "🙂👍🏽", "1234567890" * 30,
    "it's we'll 'S don't. x'll, 's.", "a\r\n\r\n  b\n", "a.b,c.", "$.x a_. b. ..c", "²a ½.", "a1.2b", "é.è!  ?x", "x.\x1f.y", "<|endoftext|> it",
    "".join(random.Random(1).choices("abcdefghij", k=4000)), "\x00\x7f\x85 a", "ﬁ İ ΑΣ.", " " * 300 + "x",
]


def test_ids_are_those_of_the_library():
    coder = Coder(RANKS, public_tokenizers.PATTERN)
    encoded = coder.encode(ODD)
    assert [list(i) for i in encoded] == [LIBRARY.encode_ordinary(t) for t in ODD]
    assert coder.decode(encoded) == [t.encode() for t in ODD]
    assert coder.encode([]) == []


def test_random_texts_round_trip():
    rng = random.Random(7)
    letters = "ab cdE.,'\n\t!é日1_ s"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    coder = Coder(RANKS, public_tokenizers.PATTERN)
    encoded = coder.encode(texts)
    assert [list(i) for i in encoded] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert coder.decode(encoded) == [t.encode() for t in texts]


def test_rows(documents):
    rows = [*EDGES, *enumerate(ODD, 50)]
    got = encode_decode(documents(rows), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True, ids))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert by_id(encode_decode(documents([]), PATH, public_tokenizers.PATTERN)) == []


def test_workers_keep_no_coder(spark, documents):
    """Workers are used again; what a coder holds would stay with them while other steps run."""
    docs = documents((k, " ".join(prose(k, 50))) for k in range(8)).repartition(4)
    encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()

    def coders(batches):
        n = sum(type(o).__name__ == "Coder" for o in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [n] * batch.num_rows})

    assert {r["n"] for r in docs.select("doc_id").mapInArrow(coders, "n long").collect()} == {0}
