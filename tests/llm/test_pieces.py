"""Encoding and token counts against the library itself, switched to its unigram mode."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from riskframe.llm import pieces, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model_file(tmp_path_factory):
    """The public model in unigram mode.  The library adds in single precision, so its pieces of several spaces, at -1e9
    each, would blur differences of up to 64 in every sum; they get a score just below the others here."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def vocabulary(model_file):
    return pieces.read_vocabulary(model_file)


@pytest.fixture(scope="module")
def library(model_file):
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def test_whole_vocabulary(vocabulary, library):
    encoder, counter = pieces.Encoder(vocabulary), tokens.Counter(vocabulary)
    for piece in vocabulary.pieces:
        want = library.encode(piece.replace("▁", " ") + "s")
        assert encoder.encode(piece.replace("▁", " ") + "s").tolist() == want
        assert counter.text(piece.replace("▁", " ") + "s") == len(want)


def sample_texts(n=400):
    rng = random.Random(3)
    letters = "etaoinshrdlu,.'XYZ0123456789éüßñ日本 "
    made = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(n)]
    return made + ["Hello  world", " lead", "trail ", "the theatre of the thing", "a" * 40, "internationalisation", "   ", "x"]


def test_encoding_equals_the_library(vocabulary, library):
    encoder, counter, decoder = pieces.Encoder(vocabulary), tokens.Counter(vocabulary), pieces.Decoder(vocabulary)
    for text in sample_texts():
        want = library.encode(text)
        assert encoder.encode(text).tolist() == want, text
        assert counter.text(text) == len(want)
        assert decoder.decode(want) == text == library.decode(want)


def test_unknown_characters_become_bytes(vocabulary, library):
    encoder, counter, decoder = pieces.Encoder(vocabulary), tokens.Counter(vocabulary), pieces.Decoder(vocabulary)
    for text in ("\n", "a\nb", "😀", "\x00\t", "ab\n\ncd 𓀀 x", "ꙮꙮ"):
        want = library.encode(text)
        assert encoder.encode(text).tolist() == want
        assert counter.text(text) == len(want)
        assert decoder.decode(want) == text


def test_ties_keep_the_longest_last_piece():
    words = pieces.Vocabulary(["a", "b", "c", "ab", "bc", "▁"], [-2.0, -2.0, -2.0, -3.0, -3.0, -1.0], None, 99)
    # ab+c and a+bc both cost 5: the longer last piece stays.
    assert pieces.Encoder(words).segment(["abc"])[0].tolist() == [0, 4]
    assert tokens.Counter(words).count(["abc"]).tolist() == [2]


def test_counts_and_ids_agree_without_bytes():
    rng = random.Random(5)
    for _ in range(300):
        chosen = sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(8)})
        words = pieces.Vocabulary(chosen, [-float(rng.randint(1, 5)) for _ in chosen], None, 1000)
        unit = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        got = pieces.Encoder(words).segment([unit, "b"])[1]
        assert tokens.Counter(words).count([unit, "b"]).tolist() == got.tolist()
        assert brute(words, unit) == pytest.approx(spent(words, unit))


def brute(words, unit):
    scores = dict(zip(words.pieces, words.scores))
    best = [0.0] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        options = [best[s] + scores[unit[s:end]] for s in range(end) if unit[s:end] in scores]
        if unit[end - 1] not in scores:
            options.append(best[end - 1] + words.unknown_score)
        best[end] = max(options)
    return best[-1]


def spent(words, unit):
    """Score of the encoder's own choice, unknown characters taken one by one."""
    encoder = pieces.Encoder(pieces.Vocabulary(words.pieces, words.scores, [2000 + b for b in range(256)], 1000))
    return sum(words.scores[i] if i < 1000 else words.unknown_score for i in encoder.segment([unit])[0].tolist())


def test_frames(spark, vocabulary):
    rows = [(1, "Hello world", 7), (2, None, 8), (3, "", 9), (3, "Hello world", 9), (4, "x" * 50_000 + " " + "ab " * 3000, 1), (None, "a▁b\n", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r["doc_id"], r["n_tokens"]): r for r in pieces.round_trip(docs, vocabulary).collect()}
    counts = sorted(((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs, vocabulary).collect()), key=repr)
    assert counts == sorted(got, key=repr)
    assert all(r["same"] for r in got.values())
    assert got[2, 0]["ids"] is None and got[3, 0]["ids"] == []
    empty = docs.limit(0)
    assert pieces.round_trip(empty, vocabulary).count() == tokens.token_counts(empty, vocabulary).count() == 0
