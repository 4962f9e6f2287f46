import hashlib
import random

import pytest
import sentencepiece

from tradewell.llm import piece_codec, queries
from tradewell.llm.piece_codec import SPACE, PieceCodec, model_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(model_path())


def test_query_equals_the_library_on_every_text(spark, sf, library):
    got = {r.doc_id: r for r in queries.op4_piece_codec(spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_random_texts(codec, library):
    rng = random.Random(5)
    letters = f"abcdefgh  {SPACE}\n\té日本①🙂\x00thewing.,<0x0A></s>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert codec.encode(text) == library.encode(text)
        joined = "".join(rng.choice(codec.pieces[259:]) for _ in range(rng.randint(1, 8))).replace(SPACE, " ")
        assert codec.encode(joined) == library.encode(joined)


@pytest.mark.parametrize("n", [*range(40), 63, 64, 65, 200])
def test_runs_of_spaces(codec, library, n):
    for end in ("", "a", "\n", "x  y"):
        assert codec.encode(" " * n + end) == library.encode(" " * n + end)


def test_decoding_any_ids(codec, library):
    rng = random.Random(6)
    for _ in range(5000):
        pick = lambda: rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 259])
        ids = [pick() for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids)


def test_a_step_back_is_taken_where_the_longest_piece_leads_nowhere(codec):
    """Not only greedy: some words need it, and the merges themselves agree."""
    rng, steps = random.Random(7), 0
    for _ in range(4000):
        word = SPACE + "".join(rng.choice("abcdeinorstlu") for _ in range(rng.randint(2, 12)))
        found = [codec.text_of(s) for s in codec.split(word)]
        assert found == codec.merged(word)
        at = greedy = 0
        while at < len(word):
            size = max(n for n in range(1, 17) if word[at : at + n] in codec.ids and at + n <= len(word))
            at, greedy = at + size, greedy + 1
        steps += greedy != len(found)
    assert steps > 100


def test_odd_rows(spark, odd, empty, clash, library):
    got = piece_codec.encode_documents(odd).collect()
    want = [(r.doc_id, library.encode(r.text or "")) for r in odd.collect()]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), ids) for i, ids in want)
    assert sorted(map(str, piece_codec.encode_documents(clash).collect())) == sorted(map(str, got))
    assert piece_codec.encode_documents(empty).collect() == []
    big = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in piece_codec.encode_documents(big).collect()} == {2**53 + 1, None}
