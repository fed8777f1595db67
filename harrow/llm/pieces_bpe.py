"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent pairs."""

from __future__ import annotations

import re
import zlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.common import read
from harrow.llm.registry import query

SPACE = "▁"          # stands for a blank inside pieces
MODEL = "piece_bpe_32k.model"
REMEMBERED = 500_000      # stretches whose encoding a task keeps; it forgets all when full
REMEMBERED_LENGTH = 64    # characters of a stretch worth keeping
SHORT = 32                # characters up to which a list is a faster agenda than a heap
NEVER = float("inf")
CHECKED_ONE_IN = 8        # texts that the library encodes and decodes too


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and where no merge can cross.

    Characters that stand side by side in some piece are of one kind, and so are all that such pairs join
    up. Two of different kinds are never in one symbol, so the text is cut between them, and each
    stretch has an agenda of its own; blanks stay with what follows. The result is that of one agenda.
    """

    def __init__(self, library):
        ids = range(library.vocab_size())
        self.library = library
        self.pieces = [library.id_to_piece(i) for i in ids]
        self.unknown, self.end = library.unk_id(), library.eos_id()
        self.silent = {i for i in ids if library.is_control(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        special = self.silent | set(self.byte_of) | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.ranks = {p: -library.get_score(i) for p, i in self.ids.items()}   # least is merged first
        self.texts = ["" if i in self.silent else " ⁇ " if i == self.unknown else
                      self.pieces[i].replace(SPACE, " ") for i in ids]
        self.unused = {self.pieces[i] for i in ids if library.is_unused(i)}
        self.prefixed = library.normalize("a").startswith(SPACE)
        self.known: dict[str, tuple[int, ...]] = {}
        self.stretches = self._pattern().findall

    def _pattern(self) -> re.Pattern:
        """What a stretch is: blanks and then characters of one kind, or one character of no kind."""
        pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        if not self.byte_ids or any(b == SPACE != a for a, b in pairs):
            return re.compile(".+", re.DOTALL)      # unknown neighbours are one piece, or a blank ends pieces
        kinds: dict[str, set[str]] = {}
        for a, b in pairs:
            if SPACE not in (a, b) and kinds.setdefault(a, {a}) is not kinds.setdefault(b, {b}):
                more, less = sorted((kinds[a], kinds[b]), key=len, reverse=True)
                more |= less
                kinds.update(dict.fromkeys(less, more))
        sets = sorted({id(k): "".join(sorted(k)) for k in kinds.values()}.values(), key=len, reverse=True)
        ways = [f"[{re.escape(k)}]+" for k in sets] + [f"[^{SPACE}]"]
        return re.compile(f"{SPACE}*(?:{'|'.join(ways)})|{SPACE}+", re.DOTALL)

    @classmethod
    def load(cls, file: str) -> "Vocabulary":
        import sentencepiece

        return cls(sentencepiece.SentencePieceProcessor(model_file=file))

    def merged(self, text: str) -> list[str]:
        """The symbols left of a text when no adjacent pair makes a piece any more.

        All adjacent pairs that make a piece wait on one agenda; the best score goes first, the
        leftmost of equal ones. A short text has the agenda as a list by place. A longer one has a
        heap, where a pair one of whose symbols has changed since is passed over.
        """
        symbols, ranks, unused = list(text), self.ranks, self.unused
        n = len(symbols)
        if n <= SHORT and not unused:
            agenda = [ranks.get(text[i:i + 2], NEVER) for i in range(n - 1)]
            while agenda:
                best = min(agenda)
                if best == NEVER:
                    break
                i = agenda.index(best)
                symbols[i] += symbols.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = ranks.get(symbols[i] + symbols[i + 1], NEVER)
                if i:
                    agenda[i - 1] = ranks.get(symbols[i - 1] + symbols[i], NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        parts: dict[str, tuple[str, str]] = {}
        agenda = []
        for right in range(1, n):
            piece = text[right - 1:right + 1]
            if piece in ranks:
                agenda.append((ranks[piece], right - 1, right, piece))
                if piece in unused:
                    parts[piece] = piece[0], piece[1]
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != len(piece):
                continue
            symbols[left], symbols[right] = piece, ""
            previous, following = before[left], after[right]
            after[left] = following
            if following < n:
                before[following] = left
                joined = piece + symbols[following]
                if joined in ranks:
                    heappush(agenda, (ranks[joined], left, following, joined))
                    if joined in unused:
                        parts[joined] = piece, symbols[following]
            if previous >= 0:
                joined = symbols[previous] + piece
                if joined in ranks:
                    heappush(agenda, (ranks[joined], previous, left, joined))
                    if joined in unused:
                        parts[joined] = symbols[previous], piece
        left_over = [s for s in symbols if s]
        return list(chain.from_iterable(self._apart(s, parts) for s in left_over)) if parts else left_over

    @staticmethod
    def _apart(symbol: str, parts: dict[str, tuple[str, str]]) -> list[str]:
        """A symbol the vocabulary marks as unused, as the symbols it was merged from."""
        done, waiting = [], [symbol]
        while waiting:
            s = waiting.pop()
            if s in parts:
                waiting.extend(reversed(parts[s]))
            else:
                done.append(s)
        return done

    def _symbol_ids(self, symbol: str) -> tuple[int, ...]:
        if symbol in self.ids:
            return self.ids[symbol],
        if self.byte_ids:
            return tuple(self.byte_ids[b] for b in symbol.encode("utf-8"))
        return self.unknown,

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of normalised text."""
        ids = list(chain.from_iterable(map(self._symbol_ids, self.merged(text))))
        if not self.byte_ids:   # unknown neighbours are one piece
            ids = [i for k, i in enumerate(ids) if k == 0 or i != self.unknown or ids[k - 1] != i]
        if len(text) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text and the end id; a NULL counts as an empty text."""
        normal = self.library.normalize(text) if text else ""
        known = self.known
        ids = list(chain.from_iterable([known.get(s) or self.stretch(s) for s in self.stretches(normal)]))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the blank that normalising puts before a text goes.

        Bytes that are no UTF-8 become U+FFFD, one for each byte.
        """
        if self.byte_of.keys().isdisjoint(ids) and self.unknown not in ids:
            text = "".join(map(self.texts.__getitem__, ids))
            return text.removeprefix(" ") if self.prefixed else text
        out: list[str] = []
        held = bytearray()
        start = self.prefixed

        def settle() -> None:
            while held:
                try:
                    out.append(held.decode("utf-8"))
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[:e.start].decode("utf-8") + "�")
                    del held[:e.start + 1]

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                start = False
                continue
            settle()
            if i in self.silent:
                continue
            piece = self.texts[i]
            if start and i != self.unknown:
                piece = piece.removeprefix(" ")
            start = False
            out.append(piece)
        settle()
        return "".join(out)


ENCODED = "doc_id long, ids array<int>, decoded string, agrees boolean"


def encoded(docs: DataFrame, file: str, check_one_in: int | None = CHECKED_ONE_IN) -> DataFrame:
    """``doc_id, ids, decoded, agrees``: documents encoded with a model file, end id last, and decoded.

    The file is a path that all executors can read; its vocabulary is of the merge type, without
    pieces that users defined. Whole texts go through the agenda, Arrow batch by Arrow batch. One in so many of them,
    by a hash of the text, the library encodes and decodes as well: ``agrees`` says whether it came to the
    same ids and text, and is NULL for the others. One row per row, whatever its id: NULL, empty and
    repeated ones as well. A NULL text counts as an empty one and is the end id alone. Other
    columns are not looked at.
    """
    def run(batches):
        vocabulary = Vocabulary.load(file)
        library = vocabulary.library
        for batch in batches:
            flat, ends, decoded, agrees = array("i"), array("i", [0]), [], []
            for text in batch.column("text").to_pylist():
                ids = vocabulary.encode(text)
                plain = vocabulary.decode(ids)
                flat.extend(ids)
                ends.append(len(flat))
                decoded.append(plain)
                looked_at = check_one_in and zlib.crc32((text or "").encode("utf-8")) % check_one_in == 0
                agrees.append(
                    library.encode(text or "", add_eos=True) == ids and library.decode(ids) == plain
                    if looked_at else None)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), lists, pa.array(decoded, pa.string()),
                 pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees`` of encoded documents."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


@query("op11_sentencepiece")
def op11_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return digests(encoded(read(spark, sf, "documents"), public_tokenizers.path(MODEL)))
