"""Agenda encoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest

from harrow.llm import pieces_bpe
from harrow.llm.pieces_bpe import SPACE, Vocabulary, digests, encoded
from tests.conftest import rows

FILE = public_tokenizers.path(pieces_bpe.MODEL)
CHARACTERS = [" ", SPACE, "a", "b", "e", "t", "h", "\n", "\t", "\x00", "é", "漢", "字", "😀", "ﬁ", "0", "<", "s", ">",
              "/", "́", "�"]
ODD = [None, "", " ", "   ", "\n", "\x00", SPACE, " a", "a ", "<s></s><unk><0x41>", "a" * 3000, " " * 3000,
       "ab" * 2000, "the the the", "the the the", "漢字" * 500, "x" + " y" * 5000]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(FILE)


def test_random_texts_and_ids_as_in_the_library(vocabulary):
    r, library = random.Random(1), vocabulary.library
    for _ in range(3000):
        text = "".join(r.choice(CHARACTERS) for _ in range(r.randint(0, 40)))
        assert vocabulary.encode(text) == library.encode(text, add_eos=True), text
        ids = [r.choice([r.randrange(library.vocab_size()), r.randrange(300)]) for _ in range(r.randint(0, 10))]
        assert vocabulary.decode(ids) == library.decode(ids), ids


def test_all_characters_of_the_vocabulary_in_any_order(vocabulary):
    """No cut between two characters of which a piece is made."""
    r = random.Random(5)
    characters = sorted({c for p in vocabulary.ids for c in p})
    for _ in range(1500):
        text = "".join(r.choice(characters) for _ in range(60))
        assert vocabulary.encode(text) == vocabulary.library.encode(text, add_eos=True), text
    for piece in r.sample(sorted(vocabulary.ids), 5000):
        text = piece + r.choice(["", ".", " ", "s"]) + piece
        assert vocabulary.encode(text) == vocabulary.library.encode(text, add_eos=True), text


def test_list_and_heap_agree(vocabulary, monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abcehtions ") for _ in range(r.randint(1, 30))).replace(" ", SPACE)
             for _ in range(500)]
    short = [vocabulary.merged(t) for t in texts]
    monkeypatch.setattr(pieces_bpe, "SHORT", 0)
    assert [vocabulary.merged(t) for t in texts] == short


def test_memory_that_forgets(monkeypatch):
    monkeypatch.setattr(pieces_bpe, "REMEMBERED", 3)
    vocabulary = Vocabulary.load(FILE)
    text = "many different words forget one another, and again many different words"
    assert vocabulary.encode(text) == vocabulary.library.encode(text, add_eos=True)
    assert len(vocabulary.known) <= 3


class _Toy:
    """A library of a few pieces: unused ones, no bytes, an unknown id."""

    pieces = ["<unk>", "<s>", "</s>", SPACE, "a", "b", "ab", "abab"]
    scores = [0, 0, 0, -9, -9, -9, -1, -2]

    def vocab_size(self): return len(self.pieces)
    def id_to_piece(self, i): return self.pieces[i]
    def get_score(self, i): return self.scores[i]
    def unk_id(self): return 0
    def eos_id(self): return 2
    def is_control(self, i): return i in (1, 2)
    def is_byte(self, i): return False
    def is_unused(self, i): return i == 7
    def normalize(self, text): return (SPACE + text.replace(" ", SPACE)) if text else ""


def test_unused_pieces_come_apart_and_unknown_neighbours_are_one():
    vocabulary = Vocabulary(_Toy())
    assert vocabulary.encode("ababab") == [3, 6, 6, 6, 2]
    assert vocabulary.encode("axyzb?") == [3, 4, 0, 5, 0, 2]
    assert vocabulary.decode([3, 4, 0, 5, 2]) == "a ⁇ b"


def test_odd_rows_and_other_columns(spark):
    data = [(i, t, None, "ids") for i, t in enumerate(ODD)] + [(None, "no id", 1, "x"), (3, ODD[3], None, "ids")]
    docs = spark.createDataFrame(data, "doc_id long, text string, agrees int, ids string")
    library = Vocabulary.load(FILE).library
    found = rows(digests(encoded(docs.repartition(3), FILE, check_one_in=1)))

    def expected(doc_id, text):
        ids = library.encode(text or "", add_eos=True)
        return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)

    assert found == sorted((expected(d, t) for d, t, *_ in data), key=lambda r: tuple((v is not None, v) for v in r))
    some = digests(encoded(docs, FILE))
    assert 0 < some.where("agrees IS NOT NULL").count() < len(data) and some.where("NOT agrees").isEmpty()
    plain = encoded(docs, FILE, check_one_in=None)
    assert plain.where("agrees IS NOT NULL").isEmpty()
    assert rows(digests(plain).drop("agrees")) == [r[:4] for r in found]
    assert encoded(docs.limit(0), FILE).collect() == []
