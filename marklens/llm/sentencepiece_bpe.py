"""SentencePiece merge-type encoding and decoding, exact, by backtracking over longest matches.

A sequence of pieces is what merging would give exactly if every two neighbours are: merging the text of the two anew
must give the two again. So a text is read from left to right with the longest piece that fits; a piece that is not
compatible with the one before is replaced by the next shorter one, and where none is left the last piece is taken
back. A bitfield of positions that led nowhere, and a search that reads a window of the text, keep this linear.

Pieces hold white-space marks only at their front, so nothing merges across the end of a word, nor across a line end that
is no piece. If a model is like that (it is checked), texts are cut there and recent words are kept in a bounded table;
otherwise texts are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
# Entries and characters of each of the two tables of recent words, the longest part that is kept there, and entries of
# the table of compared neighbours.
WORDS_KEPT = 250_000
CHARACTERS_KEPT = 4_000_000
LONGEST_KEPT = 1_000
PAIRS_KEPT = 500_000
# Characters that a search for pieces is given at first, and at most; a search costs time by what it is given.
FIRST_WINDOW = 64
LAST_WINDOW = 1 << 16


class Bpe:
    """A merge-type model: its normal pieces with their scores, its byte pieces, and how text is prepared."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {
            i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)
        }
        self.id_of_byte = {byte: i for i, byte in self.byte_of.items()}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_of and i not in special}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.unknown = model.unk_id()
        # What the model does to a text before it merges; the library is asked, so that other models are refused.
        if model.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}" or len(self.byte_of) != 256:
            raise ValueError("only models with a leading mark, kept white space and byte pieces are supported")
        self.words_apart = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        # Line ends without a piece of their own stand between what is around them, so texts can be cut there too.
        apart = "".join(c for c in "\n\r\t" if c not in self.ids)
        self.part_pattern = f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" + (f"|[{apart}]" if apart else "")
        self._build()

    def _build(self) -> None:
        """Ranks, last merges, the automaton of pieces that merging can give, and the next shorter beginning of each."""
        levels = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        shared = Counter(self.scores.values())
        self.characters = frozenset(piece for piece in self.ids if len(piece) == 1)
        # Two pieces that share a score are ordered by place alone; only full merging tells what that gives.
        self.rank = [levels[self.scores[p]] if p in self.ids else 0 for p in self.pieces]
        self.by_place = {i for piece, i in self.ids.items() if len(piece) > 1 and shared[self.scores[piece]] > 1}
        # The two pieces that a piece was last merged of; a character is its own.
        self.left_half, self.right_half = list(range(len(self.pieces))), list(range(len(self.pieces)))
        self.pair_rank: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for piece, i in self.ids.items():
            last: list[tuple[str, str]] = []
            if len(piece) > 1:
                if self.merged(piece, last) != [piece]:
                    continue
                self.left_half[i], self.right_half[i] = (self.ids[half] for half in last[-1])
            reachable.add(piece)
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.pair_rank[left << 20 | right] = self.rank[i]
        self.length = list(map(len, self.pieces))
        self.longest = max(map(len, reachable))
        self.numbers = list(map(str, range(len(self.pieces))))
        self.byte_pieces = frozenset(self.byte_of)
        self.shorter = [-1] * len(self.pieces)
        for piece in reachable:
            beginnings = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.shorter[self.ids[piece]] = next((self.ids[b] for b in beginnings if b in reachable), -1)
        # Filled while texts are read: neighbours compared, and results of recent words and of those before them.
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.known_characters = 0
        self.known_before: dict[str, tuple[str, int, str]] = {}

    def merged(self, text: str, merges: list[tuple[str, str]] | None = None) -> list[str]:
        """Plain merging: of all neighbours that form a piece the best score goes first, then the leftmost.

        The merges made are appended to `merges`, in order.
        """
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        scores = self.scores
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                joined = symbols[left] + symbols[right]
                if joined in scores:
                    heapq.heappush(heap, (-scores[joined], left, joined))

        for left in range(len(symbols) - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            if symbols[left] is None:
                continue
            right = after[left]
            if right >= len(symbols) or symbols[left] + symbols[right] != joined:
                continue
            if merges is not None:
                merges.append((symbols[left], symbols[right]))
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [symbol for symbol in symbols if symbol is not None]

    def _fits(self, left: int, right: int) -> bool:
        """Merging the text of two neighbours anew gives the two again."""
        pair = left << 20 | right
        fits = self.compatible.get(pair)
        if fits is None:
            if len(self.compatible) >= PAIRS_KEPT:
                self.compatible.clear()
            if left in self.by_place or right in self.by_place:
                fits = self.merged(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]
            else:
                fits = self._stay_apart(left, right)
            self.compatible[pair] = fits
        return fits

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges next to the boundary, latest first, and see if one across it would have come before them.

        At equal rank the leftmost merge comes first: one across the boundary before one right of it, after one left.
        """
        rank, left_half, right_half, merge = self.rank, self.left_half, self.right_half, self.pair_rank.get
        earliest = 1 << 40
        while True:
            if merge(left << 20 | right, earliest) < earliest:
                return False
            inner_left, inner_right = right_half[left], left_half[right]
            if inner_left != left and (inner_right == right or rank[left] > rank[right]):
                earliest, left = rank[left], inner_left
            elif inner_right != right:
                earliest, right = rank[right] + 1, inner_right
            else:
                return True

    def split(self, text: str) -> list[int] | None:
        """Ids of a text of known characters; None if one is unknown.

        Pieces are searched for in a window of the text, anew after a step back and where a piece might cross its end.
        """
        lengths, shorter, compatible = self.length, self.shorter, self.compatible
        size, at, last = len(text), 0, -1
        # Each step of the automaton's search gives the longest piece that begins where the one before ended.
        width = max(FIRST_WINDOW, 2 * self.longest)
        longest, start, safe = self.automaton.iter_long(text[:width]), 0, size if size <= width else width - self.longest
        failed: bytearray | None = None
        chosen: list[int] = []
        while at < size:
            if at > safe:
                width = min(2 * width, LAST_WINDOW)
                longest, start, safe = self._search(text, at, width)
            end, piece = next(longest, (-1, 0))
            end += start + 1
            if end - lengths[piece] != at:
                return None
            if failed is None and (last < 0 or compatible.get(last << 20 | piece)):
                chosen.append(piece)
                at, last = end, piece
                continue
            moved = False
            while (failed is not None and failed[end >> 3] >> (end & 7) & 1) or not (last < 0 or self._fits(last, piece)):
                moved = True
                piece = shorter[piece]
                while piece < 0:  # no way on from here: mark it, take the last piece back and try a shorter one
                    if failed is None:
                        failed = bytearray(size // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    taken = chosen.pop()
                    at -= lengths[taken]
                    last = chosen[-1] if chosen else -1
                    piece = shorter[taken]
                end = at + lengths[piece]
            chosen.append(piece)
            at, last = end, piece
            if moved and at < size:
                width = max(FIRST_WINDOW, 2 * self.longest)
                longest, start, safe = self._search(text, at, width)
        return chosen

    def _search(self, text: str, at: int, width: int) -> tuple[Iterator[tuple[int, int]], int, int]:
        """A search from `at`, where its window begins, and up to which place the pieces it gives are the longest."""
        end = at + width
        return self.automaton.iter_long(text[at:end]), at, len(text) if end >= len(text) else end - self.longest

    def encode_part(self, text: str) -> list[int]:
        """Ids of prepared text; a character without a piece becomes its bytes and stands between what is around it."""
        known = self.split(text)
        if known is not None:
            return known
        ids: list[int] = []
        run: list[str] = []
        for character in text:
            if character in self.characters:
                run.append(character)
                continue
            ids += self.split("".join(run))
            run.clear()
            ids += [self.id_of_byte[byte] for byte in character.encode()]
        return ids + self.split("".join(run))

    def parts(self, text: str) -> list[str]:
        """A text that is not empty as it is merged, cut where no merge can cross."""
        prepared = SPACE + text.replace(" ", SPACE)
        return re.findall(self.part_pattern, prepared) if self.words_apart else [prepared]

    def encode(self, text: str) -> list[int]:
        """Ids without begin and end ids; none for an empty text."""
        if not text:
            return []
        return [number for part in self.parts(text) for number in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces joined to characters, marks to spaces, the leading mark dropped."""
        if self.byte_pieces.isdisjoint(ids):
            joined = "".join([self.pieces[number] for number in ids]).replace(SPACE, " ")
            return joined[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else joined
        text: list[str] = []
        waiting = bytearray()
        for number in ids:
            if number in self.byte_of:
                waiting.append(self.byte_of[number])
                continue
            if waiting:
                text.append(waiting.decode("utf-8", "replace"))
                waiting.clear()
            text.append(self.pieces[number])
        if waiting:
            text.append(waiting.decode("utf-8", "replace"))
        joined = "".join(text).replace(SPACE, " ")
        return joined[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else joined

    def part_result(self, part: str) -> tuple[str, int, str]:
        """Ids as decimal text, their number, and the decoded text with its leading space, of a part."""
        found = self.known_before.get(part)
        if found is None:
            ids = self.encode_part(part)
            space = " " if self.pieces[ids[0]].startswith(SPACE) else ""
            found = (",".join([self.numbers[i] for i in ids]), len(ids), space + self.decode(ids))
        if len(part) > LONGEST_KEPT:
            return found
        if len(self.known) >= WORDS_KEPT or self.known_characters >= CHARACTERS_KEPT:
            self.known_before.clear()
            self.known, self.known_before = self.known_before, self.known
            self.known_characters = 0
        self.known[part] = found
        self.known_characters += len(part)
        return found

    def results(self, text: str) -> list[tuple[str, int, str]]:
        """The result of each part of a text, recent ones looked up."""
        found = []
        recent = self.known.get
        for part in self.parts(text):
            result = recent(part)
            if result is None:
                result = self.part_result(part)
                recent = self.known.get
            found.append(result)
        return found


def _on_workers(model_file: str) -> Callable[[], Bpe]:
    """The model's tables, built once by the driver (their size is the model's) and kept by each Python worker."""
    tables = SparkSession.active().sparkContext.broadcast(vars(Bpe(model_file)))

    def model() -> Bpe:
        bpe = Bpe.__new__(Bpe)
        bpe.__dict__ = tables.value
        return bpe

    return model


def encoded(text: Column, model_file: str = MODEL) -> Column:
    """Struct of `ids` (array of INT) and `decoded` per text; NULL counts as empty."""

    model_here = _on_workers(model_file)

    def rows(texts: list[str]) -> Iterator[tuple]:
        model = model_here()
        for value in texts:
            ids = model.encode(value)
            yield ids, model.decode(ids)

    return per_text("ids array<int>, decoded string", rows)(F.coalesce(text, F.lit("")))


def digested(text: Column, model_file: str = MODEL) -> Column:
    """Struct of `n_tokens`, `ids_sha256` and `decoded_sha256` per text, without sending the ids to the JVM."""

    model_here = _on_workers(model_file)

    def rows(texts: list[str]) -> Iterator[tuple]:
        model = model_here()
        for value in texts:
            ids, counts, texts_of_parts = zip(*model.results(value), strict=True) if value else ((), (), ())
            decoded = "".join(texts_of_parts).removeprefix(" ")  # every prepared text begins with the mark
            yield (
                sum(counts),
                hashlib.sha256(",".join(ids).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )

    return per_text("n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows)(F.coalesce(text, F.lit("")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digested(F.col("text")).alias("r")).select("doc_id", "r.*")
