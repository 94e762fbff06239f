"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside, outside.

The field sees a token's shape, its neighbouring words and what kind of text it stands in. It is trained on a bounded
sample of the given texts by gradient ascent on the exact likelihood: what the patterns mark is a secret, and so are values
of many kinds planted between the texts' own words; names, dates, versions, addresses and numbers planted alike are none.
It then finds tokens that look and stand like secrets but that no pattern covers, such as a password without a known name.

All tokens of a text are one chain, and any of them may begin a secret or go on with one: weights alone decide. A token's
score is a sum over its own make, its neighbours and its text, so what a word adds in each place is looked up once per word and
added up for whole texts as arrays. Viterbi then decodes only runs of tokens in which a secret could gain anything over the
path that is outside throughout; an upper bound of that gain tells which, and the path found is the best of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import per_text, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HEX_ONLY = bytes(49 if byte in b"0123456789abcdef" else 32 for byte in range(256))

TOKEN_CHARACTERS = "A-Za-z0-9+/_=-"
HINTS = ("key", "auth", "bearer", "credential", "pwd", "passphrase", "login", "private")
# A token that is like a secret has this many characters with a digit and a letter, with a digit, or with a letter.
POSSIBLE_LENGTH, POSSIBLE_NUMBER, POSSIBLE_WORD = 6, 16, 20
_TOKEN = re.compile(rf"[{TOKEN_CHARACTERS}]+|[^\s{TOKEN_CHARACTERS}]")
_DIGITS = re.compile("[0-9]+")
_LONG = re.compile(rf"[{TOKEN_CHARACTERS}]{{{POSSIBLE_WORD},}}")
_NAME = re.compile("[A-Za-z_-]{1,64}=+")
# All of a text, in order: white space, the name and sign of a NAME=value, tokens, and other characters one by one.
_PIECE = re.compile(rf"\s+|[A-Za-z_-]{{1,64}}=++(?=[{TOKEN_CHARACTERS}])|[{TOKEN_CHARACTERS}]+|[^\s{TOKEN_CHARACTERS}]")
_VISIBLE = re.compile(r"\S")
_NOT_TOKEN = re.compile(rf"[^{TOKEN_CHARACTERS}]")
_TOKEN_SET = frozenset(string.ascii_letters + string.digits + "+/_=-")
# Marks that may stand within a secret.
_JOINING = frozenset(".:~!@#$%^&*?;,|")
# A token's neighbours begin at most this many characters before its start or after its end.
REACH = 80
# Neighbours before a token that it is judged by.
BEFORE = 4
# Words whose scores a task keeps, pieces scored at once, and characters of the texts that are scored together.
KEPT_WORDS, SCORED_PIECES, SCORED_CHARACTERS = 200_000, 100_000, 1_000_000

SAMPLE_ROWS = 1_000
PLANTED = 6
PLANTED_PLAIN = 6
FEATURES = 1 << 13
# What begins with a token not made like a secret, goes on after white space, or ends in a mark starts with against it;
# training moves it.
UNLIKELY = -8.0
ROUNDS = 60
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
STATES = 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, in code points, sorted by start and kind."""
    spans = []
    folded = text.lower()
    if any(hint in folded for hint in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"1" * LEAST["hex"] in text.encode("utf-8", "replace").translate(_HEX_ONLY):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _is_possible(token: str) -> bool:
    has_digit = any(c.isdigit() for c in token)
    if has_digit and len(token) >= POSSIBLE_NUMBER:
        return True
    return len(token) >= (POSSIBLE_LENGTH if has_digit else POSSIBLE_WORD) and any(c.isalpha() for c in token)


def _possible_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that could be a secret, as (start, end), in order: those with a digit, and long ones without."""
    found = {}
    done = 0
    for digits in _DIGITS.finditer(text):
        if digits.start() < done:
            continue
        start = digits.start()
        while start > done and text[start - 1] in _TOKEN_SET:
            start -= 1
        after = _NOT_TOKEN.search(text, digits.end())
        done = after.start() if after else len(text)
        start = _after_name(text, start, done)
        if _is_possible(text[start:done]):
            found[start] = done
    for long in _LONG.finditer(text):
        start = _after_name(text, *long.span())
        if start not in found and _is_possible(text[start : long.end()]):
            found[start] = long.end()
    return iter(sorted(found.items()))


def _after_name(text: str, start: int, end: int) -> int:
    """Where the value begins in a token such as NAME=value; padding at a token's end is part of it."""
    name = _NAME.match(text, start, end)
    return name.end() if name and name.end() < end else start


def chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens that may be tagged: a possible token and all that follows without white space, as (start, end)."""
    done = -1
    for start, end in _possible_tokens(text):
        if start < done:
            continue
        run = [(start, end)]
        done = end
        # Marks are kept only where a token follows them.
        while done < len(text) and text[done] in _JOINING:
            marks = done
            while marks < len(text) and text[marks] in _JOINING:
                marks += 1
            found = _TOKEN.match(text, marks)
            if found is None or not _is_token(found[0]):
                break
            run += [(at, at + 1) for at in range(done, marks)]
            run.append(found.span())
            done = found.end()
        yield run


def _is_token(text: str) -> bool:
    return not _NOT_TOKEN.search(text)


def _bucket(value: float, *edges: float) -> int:
    return sum(value >= edge for edge in edges)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


def text_features(text: str) -> list[str]:
    """What kind of text this is."""
    marks = sum(text.count(c) for c in "{};=<>")
    lines = text.count("\n") + 1
    return [f"kind:{_bucket(marks / (len(text) + 1), 0.002, 0.01, 0.05)}", f"lines:{_bucket(len(text) / lines, 20, 60, 200, 1000)}"]


_HINTED = (*ASSIGN_HINTS, *HINTS)
_ANY_HINT = re.compile("|".join(_HINTED))
LENGTHS, SIZES = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64), (8, 16, 24)
ENTROPIES, VOWELS = (1, 2, 2.5, 3, 3.5, 4, 4.5), (0.1, 0.2, 0.3, 0.45)
_VOWEL, _NOT_HEX = np.zeros(256, dtype=np.int64), np.ones(256, dtype=np.int64)
_VOWEL[list(b"aeiouyAEIOUY")], _NOT_HEX[list(b"\x000123456789abcdef")] = 1, 0


def _own_features(token: str) -> list[str]:
    """What a token is made of."""
    digits, uppers = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    letters = sum(c.isalpha() for c in token)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    entropy = 0.0
    for count in {c: token.count(c) for c in set(token)}.values():
        entropy -= count / len(token) * math.log2(count / len(token))
    entropy = round(entropy, 6)
    runs = re.findall("[A-Za-z]+", token)
    vowels = sum(c in "aeiouyAEIOUY" for c in token) / (letters or 1)
    shape = re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", token)))
    # A word of the given text, or several, with numbers between, is a name rather than a secret.
    worn = sum(len(r) >= 3 and (r.islower() or r.isupper() or r.istitle()) for r in runs) / (len(runs) or 1)
    return [
        "bias",
        f"possible:{_is_possible(token)}",
        f"length:{_bucket(len(token), *LENGTHS)}",
        f"digits:{_bucket(digits / len(token), 0.01, 0.1, 0.3, 0.6, 1)}",
        f"cases:{uppers > 0}{letters > uppers}",
        f"changes:{_bucket(changes / len(token), 0.05, 0.15, 0.3, 0.5)}",
        f"entropy:{_bucket(entropy, *ENTROPIES)}",
        f"hex:{all(c in '0123456789abcdef' for c in token)}",
        f"marks:{sum(not c.isalnum() for c in token) > 0}",
        f"vowels:{_bucket(vowels, *VOWELS)}",
        f"worn:{_bucket(worn, 0.25, 0.5, 0.75, 1)}{_bucket(len(token), 10, 20)}",
        f"shape:{shape if len(shape) < 8 else _bucket(len(shape) / len(token), 0.2, 0.4, 0.6, 0.8)}",
    ]


def _is_mark(token: str) -> bool:
    return len(token) == 1 and token not in _TOKEN_SET


def _size(token: str) -> int:
    return _bucket(len(token), *SIZES)


def _hints(word: str) -> int:
    """The hints that stand in a word, as bits."""
    word = word.lower()
    return sum(1 << bit for bit, hint in enumerate(_HINTED) if hint in word)


def _hint_features(hints: int, size: int) -> list[str]:
    return [*(f"near:{hint}" for bit, hint in enumerate(_HINTED) if hints >> bit & 1), f"hinted:{hints > 0}{size}"]


def _place_feature(place: int, word: str) -> list[str]:
    return [f"-{place}:{word.lower()}"] if len(word) < 16 else []


def _next_feature(word: str | None) -> str:
    return f"next:{word is not None if word is None or len(word) > 1 else word.lower()}"


def token_features(text: str, start: int, end: int, about_text: list[str]) -> list[int]:
    """The slots of all features of the token from `start` to `end`."""
    token, least = text[start:end], max(0, start - REACH)
    begin = least
    while begin and text[begin - 1] in _TOKEN_SET:
        begin -= 1
    before = [m[0] for m in _PIECE.finditer(text, begin, start) if m.start() >= least and not m[0].isspace()][-BEFORE:]
    after = _VISIBLE.search(text, end, end + REACH)
    hints = 0
    for word in before:
        hints |= _hints(word)
    glued = start > 0 and not text[start - 1].isspace()
    names = [
        *_own_features(token),
        f"glued:{text[start - 1] if glued else ''}",
        *(["loose"] if _is_mark(token) and (end == len(text) or text[end].isspace()) else []),
        _next_feature(_PIECE.match(text, after.start())[0] if after else None),
        *(name for place, word in enumerate(reversed(before), 1) for name in _place_feature(place, word)),
        *_hint_features(hints, _size(token)),
        *about_text,
    ]
    return [_slot(name) for name in names]


class Field:
    """Weights of the states by feature and of the steps between states."""

    def __init__(self) -> None:
        self.emit = np.zeros((FEATURES, STATES))
        self.step = np.zeros((STATES, STATES))
        self.emit[_slot("possible:False"), BEGIN] = UNLIKELY
        self.emit[[_slot("glued:"), _slot("loose")], INSIDE] = UNLIKELY

    def scores(self, tokens: list[list[int]], possible: list[bool]) -> np.ndarray:
        scores = np.stack([self.emit[slots].sum(axis=0) for slots in tokens])
        scores[~np.array(possible), BEGIN] = -np.inf
        return scores

    def _allowed(self) -> np.ndarray:
        step = self.step.copy()
        step[OUTSIDE, INSIDE] = -np.inf
        return step

    def viterbi(self, tokens: list[list[int]], possible: list[bool]) -> list[int]:
        return self.decode(self.scores(tokens, possible))

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best path of tokens with these scores, outside before and after them."""
        step = self._allowed()
        best = scores[0] + step[OUTSIDE]
        back = []
        for row in scores[1:]:
            through = best[:, None] + step
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        state = int((best + step[:, OUTSIDE]).argmax())
        path = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            path.append(state)
        return path[::-1]

    def train(self, examples: list[tuple[list[list[int]], list[bool], list[int]]], rounds: int = ROUNDS) -> None:
        """Gradient ascent on the penalised log-likelihood, by forward and backward sums over all chains of a length."""
        total = sum(len(tokens) for tokens, _, _ in examples) or 1
        groups = _by_length(examples)
        moved_emit, moved_step = np.zeros_like(self.emit), np.zeros_like(self.step)
        for _ in range(rounds):
            emit, steps = -1e-3 * self.emit * total, -1e-3 * self.step * total
            allowed = self._allowed()
            weights = np.vstack([self.emit, np.zeros((1, STATES))])
            for slots, possible, labels in groups:
                many, count, width = slots.shape
                scores = weights[slots].sum(axis=2)
                scores[..., BEGIN][~possible] = -np.inf
                forward, backward = np.empty((many, count, STATES)), np.empty((many, count, STATES))
                forward[:, 0] = scores[:, 0] + allowed[OUTSIDE]
                for t in range(1, count):
                    forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + allowed, axis=1) + scores[:, t]
                backward[:, -1] = allowed[:, OUTSIDE]
                for t in range(count - 2, -1, -1):
                    after = (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
                    backward[:, t] = np.logaddexp.reduce(allowed + after, axis=2)
                norm = np.logaddexp.reduce(forward[:, -1] + allowed[:, OUTSIDE], axis=1)
                states = np.exp(forward + backward - norm[:, None, None])
                gain = np.eye(STATES)[labels] - states
                for state in range(STATES):
                    emit[:, state] += np.bincount(
                        slots.ravel(), np.repeat(gain[..., state].ravel(), width), FEATURES + 1
                    )[:FEATURES]
                path = np.pad(labels, ((0, 0), (1, 1)), constant_values=OUTSIDE)
                np.add.at(steps, (path[:, :-1], path[:, 1:]), 1)
                steps[OUTSIDE] -= states[:, 0].sum(axis=0)
                steps[:, OUTSIDE] -= states[:, -1].sum(axis=0)
                for t in range(1, count):
                    through = forward[:, t - 1, :, None] + allowed + (scores[:, t] + backward[:, t])[:, None, :]
                    steps -= np.exp(through - norm[:, None, None]).sum(axis=0)
            moved_emit += emit**2
            moved_step += steps**2
            self.emit += 0.3 * emit / (np.sqrt(moved_emit) + 1e-8)
            self.step += 0.3 * steps / (np.sqrt(moved_step) + 1e-8)


class Scorer:
    """Scores of all tokens of whole texts under a trained field, and the runs of tokens that it tags.

    What a word adds, by itself and to its neighbours, is worked out once and kept for as many words as `KEPT_WORDS`.
    """

    # Rows of a word's table: itself, in each place before a token, as the next token, and its last character as the one before.
    OWN, PLACE, NEXT, LAST = 0, 0, BEFORE + 1, BEFORE + 2

    def __init__(self, field: Field) -> None:
        self.field = field
        bits = np.arange(1 << len(_HINTED))
        near = np.zeros((len(bits), STATES))
        for bit, hint in enumerate(_HINTED):
            near += (bits >> bit & 1)[:, None] * field.emit[_slot(f"near:{hint}")]
        sizes = range(_size("x" * 64) + 1)
        hinted = np.array([[field.emit[_slot(f"hinted:{has}{size}")] for size in sizes] for has in (False, True)])
        # By the hints before a token and the token's size.
        self.hinted = near[:, None] + hinted[(bits > 0).astype(int)]
        self.padded = np.vstack([field.emit, np.zeros(STATES)])
        self.loose = field.emit[_slot("loose")]
        self.unglued, self.last = field.emit[_slot("glued:")], field.emit[_slot(_next_feature(None))]
        step = field._allowed()
        on = max(step[BEGIN, INSIDE], step[INSIDE, INSIDE]) - step[OUTSIDE, OUTSIDE]
        self.enter = max(step[OUTSIDE, BEGIN] - step[OUTSIDE, OUTSIDE], *(step[s, BEGIN] - step[s, OUTSIDE] for s in (BEGIN, INSIDE)))
        self.leave = max(
            *(step[s, OUTSIDE] - step[OUTSIDE, OUTSIDE] for s in (BEGIN, INSIDE)), *(step[s, BEGIN] - step[OUTSIDE, BEGIN] for s in (BEGIN, INSIDE))
        )
        self.go_on = on
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1 << 10, BEFORE + 3, STATES))
        self.about = np.zeros((1 << 10, 3), dtype=np.int64)  # hints, the size or -1 for white space, and whether it is a mark
        self.made: dict[int, np.ndarray] = {}

    def _own(self, word: str) -> np.ndarray:
        return self.field.emit[[_slot(name) for name in _own_features(word)]].sum(axis=0)

    def _learn(self, words: list[str]) -> None:
        first = len(self.ids)
        self.ids.update(zip(words, range(first, first + len(words)), strict=True))
        while len(self.ids) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.about = np.concatenate([self.about, np.zeros_like(self.about)])
        emit, table, about = self.field.emit, self.table[first:], self.about[first:]
        plain = [at for at, word in enumerate(words) if 1 < len(word) < 32 and word.isascii() and word.isalnum()]
        others = set(range(len(words))).difference(plain)
        if plain:
            others.update(self._learn_plain(np.array(plain), [words[at] for at in plain], table))
        lowered = [word.lower() for word in words]
        for place in range(1, BEFORE + 1):
            seed = zlib.crc32(f"-{place}:".encode())
            slots = [zlib.crc32(word.encode("utf-8", "replace"), seed) % FEATURES if len(word) < 16 else FEATURES for word in lowered]
            table[: len(words), self.PLACE + place] = self.padded[slots]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        about[: len(words), 1] = sum((lengths >= edge).astype(np.int64) for edge in SIZES)
        table[: len(words), self.NEXT] = emit[_slot(_next_feature("xx"))]
        table[: len(words), self.LAST] = emit[[_slot(f"glued:{word[-1]}") for word in words]]
        ends = np.cumsum(lengths + 1)
        together = "\n".join(lowered)
        if len(together) == ends[-1] - 1 and together.isascii():
            for hit in _ANY_HINT.finditer(together):
                others.add(int(np.searchsorted(ends, hit.start(), "right")))
        else:
            others.update(at for at, word in enumerate(lowered) if _ANY_HINT.search(word))
        for at in others:
            word = words[at]
            if word.isspace():
                table[at], about[at] = 0, (0, -1, 0)
                table[at, self.LAST] = self.unglued
                continue
            table[at, self.OWN], table[at, self.NEXT] = self._own(word), emit[_slot(_next_feature(word))]
            about[at, 0], about[at, 2] = _hints(word), _is_mark(word)

    def _learn_plain(self, places: np.ndarray, words: list[str], table: np.ndarray) -> list[int]:
        """Own scores of words of letters or digits; returns the places of those made in another way.

        What such a word is made of follows from a few numbers, and only one word of each combination is looked at.
        """
        letters = np.array(words, dtype="S32").view(np.uint8).reshape(len(words), 32)
        length = (letters > 0).sum(axis=1)
        upper, lower = (letters >= 65) & (letters <= 90), (letters >= 97) & (letters <= 122)
        digits, uppers, lowers = ((letters >= 48) & (letters <= 57)).sum(axis=1), upper.sum(axis=1), lower.sum(axis=1)
        made = np.select([lowers == length, uppers == length, (lowers == length - 1) & upper[:, 0], digits == length], [1, 2, 3, 4], 0)
        held = np.bincount((np.arange(len(words))[:, None] * 128 + letters).ravel(), minlength=len(words) * 128).reshape(-1, 128)[:, 1:]
        logs = np.arange(33) * np.log2(np.maximum(np.arange(33), 1))
        entropy = np.round(np.log2(length) - logs[held].sum(axis=1) / length, 6)
        vowels = _VOWEL[letters].sum(axis=1) / np.maximum(uppers + lowers, 1)
        number = made
        for value, edges in ((length, LENGTHS), (length, (3,)), (entropy, ENTROPIES), (vowels, VOWELS), (_NOT_HEX[letters].sum(axis=1), (1,))):
            number = number * 16 + sum((value >= edge).astype(np.int64) for edge in edges)
        kinds, firsts, which = np.unique(number, return_index=True, return_inverse=True)
        for kind, at in zip(kinds.tolist(), firsts.tolist(), strict=True):
            if kind not in self.made:
                self.made[kind] = self._own(words[at])
        table[places, self.OWN] = np.array([self.made[kind] for kind in kinds.tolist()])[which]
        return places[made == 0].tolist()

    def _scores(self, pieces: list[str], starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens from piece `first` on, and which pieces they are; earlier pieces are only their neighbours."""
        if len(self.ids) > KEPT_WORDS:
            self._forget()
        new = set(pieces).difference(self.ids)
        if new:
            self._learn(list(new))
        ids = np.fromiter(map(self.ids.__getitem__, pieces), np.int64, len(pieces))
        at = np.flatnonzero(self.about[ids, 1] >= 0)
        own = int(np.searchsorted(at, first))
        words, begins = ids[at], starts[at]
        count = len(at)
        scores = self.table[words, self.OWN]
        glued = np.broadcast_to(self.unglued, (count, STATES)).copy()
        inner = at > 0
        glued[inner] = self.table[ids[at[inner] - 1], self.LAST]
        scores += glued
        loose = self.about[words, 2] > 0
        loose &= np.append(self.about[ids, 1] < 0, True)[at + 1]
        scores[loose] += self.loose
        following = np.broadcast_to(self.last, (count, STATES)).copy()
        if count > 1:
            near = np.flatnonzero(begins[1:] < starts[at[:-1] + 1] + REACH)
            following[near] = self.table[words[near + 1], self.NEXT]
        scores += following
        hints = np.zeros(count, dtype=np.int64)
        for place in range(1, min(BEFORE, count - 1) + 1):
            near = np.flatnonzero(begins[:-place] >= begins[place:] - REACH)
            scores[near + place] += self.table[words[near], self.PLACE + place]
            hints[near + place] |= self.about[words[near], 0]
        scores += self.hinted[hints, self.about[words, 1]]
        return scores[own:], at[own:]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of some texts in order: scores, the text's number, and where in it the token starts and ends."""
        pieces: list[str] = []
        firsts = []
        for text in texts:
            firsts.append(len(pieces))
            pieces += _PIECE.findall(text)
            pieces.append("\n")
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # Texts lie so far apart that their tokens are no neighbours.
        lengths[np.array([*firsts[1:], len(pieces)]) - 1] = REACH + 1
        ends = np.cumsum(lengths)
        starts = np.concatenate([[0], ends])
        margin = 2 * BEFORE + 2
        parts = []
        for begin in range(0, len(pieces), SCORED_PIECES):
            low, stop = max(0, begin - margin), min(len(pieces), begin + SCORED_PIECES)
            # Two pieces more show what follows the last one.
            scores, at = self._scores(pieces[low : stop + 2], starts[low:], begin - low)
            mine = at + low < stop
            parts.append((scores[mine], at[mine] + low))
        scores, at = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
        number = np.searchsorted(np.array(firsts), at, "right") - 1
        scores += np.array([self.field.emit[[_slot(name) for name in text_features(text)]].sum(axis=0) for text in texts])[number]
        offset = starts[np.array(firsts)][number]
        return scores, number, starts[at] - offset, ends[at] - offset

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text (start, end) of what its best path tags, in order."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not texts:
            return found
        scores, number, starts, ends = self.scores(texts)
        if not len(scores):
            return found
        begin = scores[:, BEGIN] - scores[:, OUTSIDE] + self.enter
        # Sums of what going on inside can gain at most, up to and with each token, and the best that may still come after it.
        # No secret goes on into the next text.
        fresh = np.concatenate([[True], number[1:] != number[:-1]])
        inside = np.cumsum(scores[:, INSIDE] - scores[:, OUTSIDE] + self.go_on - 1e4 * fresh)
        ahead = np.maximum.accumulate(inside[::-1])[::-1]
        rest = self.leave + np.maximum(0, np.append(ahead[1:], -np.inf) - inside)
        # Rounding of long sums must not hide a gain.
        slack = 1e-6 + 1e-12 * np.abs(inside).max()
        may_begin = begin + rest > -slack
        if not may_begin.any():
            return found
        so_far = np.maximum.accumulate(np.where(may_begin, begin - inside, -np.inf))
        open_ = may_begin | (so_far + inside + rest > -slack)
        runs = np.flatnonzero(open_ & (fresh | ~np.concatenate([[False], open_[:-1]])))
        stops = np.flatnonzero(open_ & np.append(fresh[1:] | ~open_[1:], True)) + 1
        for low, high in zip(runs.tolist(), stops.tolist(), strict=True):
            since = None
            for at, state in enumerate([*self.field.decode(scores[low:high]), OUTSIDE], low):
                if since is not None and state != INSIDE:
                    found[number[low]].append((int(starts[since]), int(ends[at - 1])))
                    since = None
                if state == BEGIN:
                    since = at
        return found


def _by_length(examples: list[tuple[list[list[int]], list[bool], list[int]]]) -> list[tuple[np.ndarray, ...]]:
    """Examples of one length as arrays: slots, filled up with a slot without weight, what is possible, and labels."""
    groups: dict[int, list[tuple]] = {}
    for example in examples:
        groups.setdefault(len(example[0]), []).append(example)
    arrays = []
    for count, same in sorted(groups.items()):
        width = max(len(slots) for tokens, _, _ in same for slots in tokens)
        filled = np.full((len(same), count, width), FEATURES)
        for row, (tokens, _, _) in zip(filled, same, strict=True):
            for place, slots in zip(row, tokens, strict=True):
                place[: len(slots)] = slots
        arrays.append((filled, np.array([p for _, p, _ in same], dtype=bool), np.array([y for *_, y in same])))
    return arrays


def _all_tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text) if not m[0].isspace()]


def _labels(run: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    """Begin at the run's first token that a base span covers, inside while they go on."""
    labels, before = [], None
    for start, end in run:
        cover = next(((a, b) for a, b, _ in spans if a <= start and end <= b), None)
        labels.append(OUTSIDE if cover is None else INSIDE if cover == before else BEGIN)
        before = cover
    return labels


_LETTERS, _SMALL, _ALNUM = string.ascii_letters, string.ascii_lowercase, string.ascii_letters + string.digits

# What stands around a planted secret: `v` is the value, `w` and `x` words of the text.
SECRET_PLACES = (
    "bearer {v}", "Authorization: Bearer {v}", "Authorization: Basic {v}", "auth {v}", "x-auth: {v}", "credentials {v}",
    "credential: {v}", "client key: {v}", 'key "{v}"', "key = {v}", "export AUTH={v}", "--auth-key {v}", "pwd {v}", "pwd: {v}",
    "passphrase {v}", "passphrase is {v}", "signing key {v}", "private key {v}", "login {w} {v}", "login: {w} / {v}",
    "https://{w}:{v}@{x}.example/", "the key for {w} is {v}",
)
CLEAN_PLACES = ("{v}", "{w} {v}", "see {v}", "({v})", "{w}: {v}", "file {v}", "order {v}", "in {v}, {w}", "https://{w}.example/{v}", "keys to {v}")


def _drawn(rnd: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(rnd.choices(letters, k=rnd.randint(least, most)))


def _secret_value(rnd: random.Random, word: str) -> str:
    kind = rnd.randrange(8)
    if kind == 0:
        return f"{_drawn(rnd, _SMALL, 2, 4)}{rnd.choice('-_')}{rnd.choice(('', 'live-', 'test_'))}{_drawn(rnd, _ALNUM, 16, 40)}"
    if kind == 1:
        return _drawn(rnd, string.digits, 18, 32)
    if kind == 2:
        return _drawn(rnd, _LETTERS, 20, 40)
    if kind == 3:
        return ".".join(_drawn(rnd, _ALNUM + "_-", 14, 40) for _ in range(3))
    if kind == 4:  # a word, a number and marks, as people choose them
        return f"{word[:8] or 'pass'}{rnd.randint(1, 9999)}{rnd.choice('!#$%&*?')}{_drawn(rnd, _ALNUM, 1, 4)}"
    if kind == 5:
        return base64.b64encode(rnd.randbytes(rnd.randint(15, 36))).decode()
    return _drawn(rnd, _ALNUM, 10, 20) if kind == 6 else _drawn(rnd, _ALNUM, 20, 48)


def _clean_value(rnd: random.Random, word: str, other: str) -> str:
    number, small = rnd.randint(1, 9_999), rnd.randint(1, 28)
    return rnd.choice((
        f"{word}{other}{number}", f"{word}_{other}_{number}", f"{word}{number}{other.title()}Final", f"/{word}/{number}/{other}-{small}",
        f"{1990 + number % 40}-0{1 + small % 9}-{small:02}T10:{small:02}:00Z", f"{word.upper()}-{number}-{other.upper()}",
        f"v{small}.{number}.0-rc{small % 5}", f"{word}{number}.pdf", f"{word}.{other}{small}@mail.example", f"+49151{rnd.randint(10**7, 10**8)}",
        f"{small}th-{word}", f"{number}{rnd.choice(('mb', 'kg', 'km', 'px'))}/{word}", f"{word}{small}", f"{other}-{number}",
        f"DE{rnd.randint(10**19, 10**20 - 1)}", f"{rnd.randint(10**15, 10**16 - 1)}", f"{word}-{other}-and-{word}-of-{other}",
        f"{word}/{other}/{word}_{other}", f"{small}.{small}.{number % 255}.{small}", f"{number}-{number}-{number}-{small:04}",
    ))


def planted(text: str, count: int = PLANTED) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Examples made of the words of a text, alternately with a secret of some kind and with something else; the text alone
    decides which."""
    words = [w for w in re.findall(r"[^\W\d_]+", text)[:2_000] if w.isascii()]
    if len(words) < 8:
        return
    rnd = random.Random(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
    for number in range(2 * count):
        at = rnd.randrange(len(words) - 7)
        word, other = words[at + 3], words[at + 4]
        is_secret = number % 2 == 0
        value = _secret_value(rnd, word) if is_secret else _clean_value(rnd, word, other)
        place = rnd.choice(SECRET_PLACES if is_secret else CLEAN_PLACES)
        front, _, back = place.partition("{v}")
        front = " ".join([*words[at : at + 3], front.format(w=word, x=other)])
        shown = f"{front}{value}{back.format(w=word, x=other)}{rnd.choice((' ', '. ', ', ', chr(10)))}{' '.join(words[at + 5 : at + 8])}"
        yield shown, [(len(front), len(front) + len(value), "crf")] if is_secret else []


PLAIN_PLACES = (
    "pwd {v}", "pwd: {v}", "pwd = {v}", "pwd is {v}", "passphrase {v}", "passphrase: {v}", "passphrase is {v}", "login: {w} / {v}",
    "login {w} pwd {v}", "https://{w}:{v}@{x}.example/", "key: '{v}'", "credentials: {w} / {v}", "--auth {v}", "private key: {v}",
)
# Words that hold a hint, and what ordinarily follows them.
ORDINARY_PLACES = (
    "key {w} {v}", "the key to {v}", "a key for {w}", "keyboard {v}", "monkey {v} {x}", "author {w} {v}", "authors: {w}, {v}", "the login of {w}",
    "login page {v}", "private {w}", "a private {v}", "bearer of {w} {v}", "credentials of {w}", "passphrase of {w}", "the pwd that {w}",
    "key, {w} {v}", "key ({w})", "the secret {w} {v}", "a token {v}", "tokens {v}", "secrets: {w} {x}", "passwords {w}", "api {v}", "keys: {w}, {x}",
    "authority {w} {v}", "{w} is {v}", "{w}: {v}", "{w} / {x}", "{w} = {x}", "'{w}' {v}",
)


def planted_plain(text: str, count: int = PLANTED_PLAIN) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Examples as of `planted`, of secrets that their make does not tell from other words and numbers, and of such words."""
    words = [w for w in re.findall(r"[^\W\d_]+", text)[:2_000] if w.isascii()]
    if len(words) < 8:
        return
    rnd = random.Random(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8, salt=b"plain").digest())
    for number in range(2 * count):
        at = rnd.randrange(len(words) - 7)
        word, other = words[at + 3], words[at + 4]
        spans = []
        if number % 2 == 0:
            value = (
                _drawn(rnd, _ALNUM, 4, 8), _drawn(rnd, string.digits, 4, 12), _drawn(rnd, _LETTERS, 6, 16), words[at + 2],
                f"{words[at + 2]}{other.title()}", f"{word}-{other}", f"{word[:6]}{rnd.choice('!#$%&*?')}{_drawn(rnd, _ALNUM, 1, 3)}",
                f"{other}{rnd.randint(1, 99)}",
            )[rnd.randrange(8)]
            front, _, back = rnd.choice(PLAIN_PLACES).partition("{v}")
            front = " ".join([*words[at : at + 3], front.format(w=word, x=other)])
            spans = [(len(front), len(front) + len(value), "crf")]
            middle = f"{front}{value}{back.format(w=word, x=other)}"
        else:
            value = str(rnd.randint(1, 99_999)) if rnd.random() < 0.2 else words[at + 2]
            middle = " ".join([*words[at : at + 3], rnd.choice(ORDINARY_PLACES).format(w=word, x=other, v=value)])
        yield f"{middle}{rnd.choice((' ', '. ', ', ', chr(10)))}{' '.join(words[at + 5 : at + 8])}", spans


def trained_field(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Field:
    """A field trained on at most `sample_rows` texts: those of the least hash among texts with a digit in a long token.

    Half of the sample are texts with an assignment; `planted` adds examples of both classes made of the texts' words. The
    sample is bounded, and only it reaches the driver. Without such texts nothing is learnt, and the field tags nothing.
    """
    value = F.col(text)
    clue = value.rlike(r"(?i)(passw|secret|token|api_?key)[\"']? *[:=]")
    long_token = value.rlike(r"[A-Za-z][A-Za-z0-9+/_=-]{5,}[0-9]|[0-9][A-Za-z0-9+/_=-]{5,}[A-Za-z]")
    key = F.xxhash64(value)
    # Hashes alone decide which texts are taken; only then are texts looked at, each once however often it occurs.
    keys = cut_lineage(docs.filter(long_token).select(key.alias("key"), clue.alias("clue")).distinct())
    chosen = [
        row["key"] for wanted in (True, False)
        for row in keys.filter(F.col("clue") == wanted).select("key").orderBy("key").limit(sample_rows // 2).collect()
    ]
    found = docs.filter(key.isin(chosen)).groupBy(key.alias("key")).agg(F.min(value).alias("text")) if chosen else None
    picked = [row["text"] for row in found.orderBy("key").collect()] if chosen else []
    examples = []
    for value in picked:
        for shown, spans in [(value, base_spans(value)), *planted(value), *planted_plain(value)]:
            about = text_features(shown)
            # Of the text itself only what the patterns mark is known; of an example, every token.
            for run in chains(shown) if shown is value else [_all_tokens(shown)]:
                labels = _labels(run, spans)
                if shown is value and labels[0] == OUTSIDE:
                    continue
                tokens = [token_features(shown, a, b, about) for a, b in run]
                examples.append((tokens, [True] * len(run), labels))
    field = Field()
    field.emit[:, OUTSIDE] += 0.05  # undecided tokens are outside
    if examples:
        field.train(examples)
    return field


def all_spans(text: str, field: Field | Scorer) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and these with the field's spans that no base span overlaps."""
    scorer = field if isinstance(field, Scorer) else Scorer(field)
    return _with_base(text, scorer.tagged([text])[0])


def _with_base(text: str, tagged: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    added = [(start, stop, "crf") for start, stop in tagged if not any(a < stop and start < b for a, b, _ in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _in_groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= SCORED_CHARACTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scanned(text: Column, field: Field) -> Column:
    """Struct of the counts per kind, `base`, `spans` (both joined) and `redacted` (NULL where nothing was found)."""
    sent = SparkSession.active().sparkContext.broadcast((field.emit, field.step))

    held: list[Scorer] = []  # one per task, whose words all batches share

    def rows(texts: list[str]) -> Iterator[tuple]:
        if not held:
            field = Field()
            field.emit, field.step = sent.value
            held.append(Scorer(field))
        for group in _in_groups(texts):
            for value, tagged in zip(group, held[0].tagged(group), strict=True):
                base, spans = _with_base(value, tagged)
                counts = [sum(kind == wanted for _, _, kind in base) for wanted in KINDS[:3]]
                yield *counts, joined(base), joined(spans), redact(value, spans) if spans else None

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, redacted string"
    return per_text(schema, rows)(F.coalesce(text, F.lit("")))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: the id, counts of base spans, `base` and `spans` as text, and the `redacted` text.

    NULL and empty texts have no spans. Repeated rows have equal results. An empty input gives an empty result.
    """
    field = trained_field(docs, text, sample_rows)
    return docs.select(F.col(id_column), scanned(F.col(text), field).alias("r")).select(id_column, "r.*")


def without_secrets(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns, with every span found in the text replaced by `[SECRET]`; NULL texts stay NULL."""
    field = trained_field(docs, text, sample_rows)
    redacted = scanned(F.col(text), field)["redacted"]
    return docs.withColumn(text, F.coalesce(redacted, F.col(text)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )
