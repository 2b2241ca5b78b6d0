"""Personal data: patterns with checks, and a linear-chain conditional random field for what patterns leave out.

Patterns take an address, number or card only where its characters stand alone: a phone followed by a card is one run of
digits that fails every check. The field labels white-space separated words as the beginning or inside of an email, ip,
card or phone, or outside, from the shapes of a word and its neighbours (kinds of characters, numbers of digits and dots,
first and last character, a few cue words). It is trained on the marked sentences of :mod:`candora.llm.pii_examples`.
What it finds is checked like the patterns' matches and added where it doesn't overlap one of its own kind.

Decoding is exact Viterbi over whole texts, but only where it can matter. Words of plain letters among others of their
kind all have one known emission: the field is asked how many of them on both sides make the one in the middle "outside"
on every best path, whatever stands around them. Runs between such words are independent; they are decoded side by side,
position by position, in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.pii_examples import EXAMPLES
from candora.llm.shared import over_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
STEPS, RATE, PENALTY = 160, 0.15, 2e-3  # full-batch Adam
MOST_AROUND = 12  # plain words on both sides that may be needed; beyond, whole texts are decoded

# --- patterns; possessive, so that no text makes them quadratic -----------------------------------------------------

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]+")


def luhn(digits: bytes) -> bool:
    """Whether the last digit is the check digit of the others."""
    values = np.frombuffer(digits, np.uint8)[::-1].astype(np.int64) - 48
    values[1::2] *= 2
    return int((values - 9 * (values > 9)).sum()) % 10 == 0


def _is_card(text: bytes) -> bool:
    digits = b"".join(_DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: bytes) -> bool:
    return 9 <= sum(len(d) for d in _DIGITS.findall(text)) <= 15


def _is_ip(text: bytes) -> bool:
    parts = [p.lstrip(b"0") for p in text.split(b".")]
    return all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts)


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    end, at = 0, raw.find(b"@")
    while at >= 0:
        start = end + len(raw[end:at].rstrip(_LOCAL))
        found = _DOMAIN.match(raw, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = raw.find(b"@", end)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in bytes of all matches of the patterns that pass their check, sorted."""
    out = [(a, 0, b) for a, b in _emails(raw)]
    for kind, pattern, fits in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(raw) if fits(m[0])]
    return sorted(out)


# --- word shapes -----------------------------------------------------------------------------------------------------

_DIGIT, _LETTER, _CAPITAL, _OTHER_SCRIPT, _AT, _DOT, _DASH, _ROUND, _PLUS, _COLON, _SQUARE, _SIGN = (1 << k for k in range(12))
_BITS = np.full(256, _SIGN, np.int16)
for _chars, _bit in (
    (b"0123456789", _DIGIT), (b"abcdefghijklmnopqrstuvwxyz", _LETTER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CAPITAL), (b"@", _AT), (b".", _DOT),
    (b"-", _DASH), (b"()", _ROUND), (b"+", _PLUS), (b":/=", _COLON), (b"[]{}", _SQUARE),
):
    _BITS[list(_chars)] = _bit
_BITS[128:] = _OTHER_SCRIPT
_SEPARATORS = [9, 10, 11, 12, 13, 32]
_BITS[_SEPARATORS] = 0
_SIDE = np.where(_BITS > 0, np.log2(np.maximum(_BITS, 1)).astype(np.int64) + 1, 0)  # number of a character's kind
_BLANK = np.zeros(256, bool)
_BLANK[_SEPARATORS] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)

#: Cue words of at most eight bytes by group.
CUES = (
    ("at", "(at)", "[at]", "{at}"),
    ("dot", "(dot)", "[dot]", "{dot}", "punkt", "(punkt)", "punto", "(punto)", "point", "(point)"),
    ("phone", "phone:", "tel", "tel:", "tel.", "call", "fax", "fax:", "mobile", "mobile:", "telefon"),
    ("card", "card:", "visa", "visa:", "karte", "carte", "tarjeta"),
    ("ip", "ip:", "host", "server", "address"),
    ("email", "email:", "e-mail", "e-mail:", "mail", "mail:", "contact"),
    ("version", "isbn", "page", "order", "id", "nr.", "no.", "section"),
)


def _key(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


_CUE_KEYS = np.array(sorted(_key(w) for group in CUES for w in group), np.uint64)
_CUE_GROUP = np.array([g for _, g in sorted((_key(w), g) for g, group in enumerate(CUES, 1) for w in group)], np.int64)
_AMOUNTS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 16, 17, 20])  # lower ends of the classes of numbers of digits
_AMOUNT, _CUE, _DOTS, _PLACE = len(_AMOUNTS) + 1, len(CUES) + 1, 5, 13

#: Size of each feature's table: own kinds of characters, own digits and ends, own dots and digits, own cue, and kinds,
#: digits and cue of the word before and after.
SIZES = (4096, _AMOUNT * _PLACE * _PLACE, _DOTS * _AMOUNT, _CUE, 4096, _AMOUNT * _CUE, 4096, _AMOUNT * _CUE)
OFFSETS = np.r_[0, np.cumsum(SIZES)]


@dataclass
class Shapes:
    """Words of several texts: byte ranges, texts, and shapes; plain words have all zeros."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    special: np.ndarray  # places of the words with a digit, @, + or cue
    kinds: np.ndarray  # of these, as the rest
    digits: np.ndarray
    dots: np.ndarray
    ends: np.ndarray
    cue: np.ndarray


def shapes(data: np.ndarray, offsets: np.ndarray) -> Shapes:
    """Words and shapes of the texts that begin at ``offsets`` of ``data``."""
    blank = _BLANK[data]
    before = np.r_[True, blank[:-1]]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.r_[blank[1:], True]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start = np.flatnonzero(before & ~blank)
    end = np.flatnonzero(after & ~blank) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    none = np.zeros(0, np.int64)
    if not len(start):
        return Shapes(start, end, row, none, none, none, none, none, none)
    kinds = np.bitwise_or.reduceat(_BITS[data], start)  # blanks up to the next word add nothing
    size = end - start
    short = np.flatnonzero(size <= 8)
    key = np.zeros(len(short), np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    for k in range(8):
        use = size[short] > k
        key |= np.where(use, _LOWER[padded[start[short] + k]], 0).astype(np.uint64) << np.uint64(8 * k)
    place = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    cue = np.zeros(len(start), np.int64)
    cue[short] = np.where(_CUE_KEYS[place] == key, _CUE_GROUP[place], 0)
    special = np.flatnonzero((kinds & (_DIGIT | _AT | _PLUS) != 0) | (cue > 0))
    first, last = start[special], end[special]
    count = lambda what: (lambda total: total[last] - total[first])(np.r_[0, np.cumsum(what, dtype=np.int64)])
    digits = np.searchsorted(_AMOUNTS, count(data - np.uint8(48) < 10), "right")
    dots = np.minimum(count(data == 46), _DOTS - 1)
    return Shapes(start, end, row, special, kinds[special].astype(np.int64), digits, dots, _SIDE[data[first]] * _PLACE + _SIDE[data[last - 1]], cue[special])


def features(found: Shapes, words: np.ndarray) -> np.ndarray:
    """Places of each of ``words`` in the weight table, a column per feature."""

    def shape(of: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(found.special):
            zero = np.zeros(len(of), np.int64)
            return zero, zero, zero, zero, zero
        at = np.minimum(np.searchsorted(found.special, of), len(found.special) - 1)
        own = found.special[at] == of
        return tuple(np.where(own, x[at], 0) for x in (found.kinds, found.digits, found.dots, found.ends, found.cue))

    count = len(found.start)
    kinds, digits, dots, ends, cue = shape(words)
    columns = [kinds, digits * _PLACE * _PLACE + ends, dots * _AMOUNT + digits, cue]
    for step in (-1, 1):
        other = words + step
        inside = (other >= 0) & (other < count)
        inside &= found.row[np.clip(other, 0, max(count - 1, 0))] == found.row[words]
        kinds, digits, _, _, cue = shape(np.where(inside, other, -1))
        columns += [kinds, digits * _CUE + cue]
    return np.stack(columns, 1) + OFFSETS[:-1]


# --- the field -------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a linear chain: emissions by feature, transitions, first and last labels."""

    emission: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emit(self, places: np.ndarray) -> np.ndarray:
        return self.emission[places].sum(axis=1) if len(places) else np.zeros((0, LABELS))

    def around(self) -> int | None:
        """How many plain words on both sides put a plain word outside on every best path, or None.

        The words may follow any label or begin the text, and come before any label or end it; at an edge of the text
        there may be fewer of them.
        """
        own = self.emit(OFFSETS[:-1][None, :])[0]
        grow = lambda x, step: (x + own)[:, :, None] + step
        left, right = self.step.copy(), self.step.T.copy()  # score of the word's label, by the label before or after
        edges_left, edges_right = [self.first], [self.last]
        for count in range(MOST_AROUND + 1):
            lefts, rights = np.vstack([left, *edges_left]), np.vstack([right, *edges_right])
            paths = lefts[:, None, :] + rights[None, :, :] + own
            if (paths[:, :, 0] > paths[:, :, 1:].max(axis=2) + 1e-6).all():
                return count
            left, right = grow(left, self.step).max(axis=1), grow(right, self.step.T).max(axis=1)
            edges_left.append(grow(edges_left[-1][None], self.step).max(axis=1)[0])
            edges_right.append(grow(edges_right[-1][None], self.step.T).max(axis=1)[0])
        return None


def viterbi(field: Field, emitted: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Best labels of runs of words; ``opens`` and ``closes`` say which run begins or ends its text, else it meets "outside"."""
    labels = np.zeros(len(emitted), np.int8)
    back = np.zeros(emitted.shape, np.int8)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, opens, closes = starts[order], sizes[order], opens[order], closes[order]
    score = np.where(opens[:, None], field.first, field.step[0]) + emitted[starts]
    finish = np.where(closes[:, None], field.last, field.step[:, 0])
    last = np.zeros(len(starts), np.int64)
    for k in range(int(sizes.max(initial=0))):
        active = int(np.searchsorted(-sizes, -k, "left"))  # runs longer than k
        if k:
            paths = score[:active, :, None] + field.step
            best = paths.argmax(axis=1)
            back[starts[:active] + k] = best
            score[:active] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + emitted[starts[:active] + k]
        ended = np.flatnonzero(sizes[:active] == k + 1)
        last[ended] = (score[ended] + finish[ended]).argmax(axis=1)
    for k in range(int(sizes.max(initial=0)) - 1, -1, -1):
        active = int(np.searchsorted(-sizes, -k, "left"))
        at = starts[:active] + k
        labels[at] = last[:active]
        last[:active] = back[at, last[:active]]
    return labels


def decode(field: Field, found: Shapes, around: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Words that may be inside something and their best labels; ``around`` comes from the field, None looks at every word."""
    count = len(found.start)
    if around is None:
        words = np.arange(count)
    else:
        near = (found.special[:, None] + np.arange(-1 - around, 2 + around)).ravel()
        words = np.unique(near[(near >= 0) & (near < count)])
    if not len(words):
        return words, np.zeros(0, np.int8)
    new = np.r_[True, (words[1:] != words[:-1] + 1) | (found.row[words[1:]] != found.row[words[:-1]])]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(words)])
    head, tail = words[starts], words[starts + sizes - 1]
    opens = (head == 0) | (found.row[np.maximum(head - 1, 0)] != found.row[head])
    closes = (tail == count - 1) | (found.row[np.minimum(tail + 1, count - 1)] != found.row[tail])
    return words, viterbi(field, field.emit(features(found, words)), starts, sizes, opens, closes)


_MARK = re.compile(r"\{(email|ip|card|phone)\|([^}|]*(?:\[at\]|\[dot\]|\{at\})?[^}|]*)\}")


def marked(sentence: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence without its marks, and ``start, kind, end`` of what was marked (characters)."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(sentence):
        text += sentence[at : m.start()]
        spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + sentence[at:], spans


def labelled(sentences: Iterable[str]) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts and spans of marked sentences."""
    pairs = [marked(s) for s in sentences]
    return [t for t, _ in pairs], [s for _, s in pairs]


def _gold(found: Shapes, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    label = np.zeros(len(found.start), np.int64)
    begin = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for row, (text, marks) in enumerate(zip(texts, spans, strict=True)):
        for a, kind, b in marks:
            low, high = (begin[row] + len(text[:x].encode()) for x in (a, b))
            own = np.flatnonzero((found.end > low) & (found.start < high))
            label[own] = 2 * kind + 2
            label[own[:1]] = 2 * kind + 1
    return label


def fit_field(sentences: Iterable[str]) -> Field:
    """Train on marked sentences (:func:`marked`): the penalised conditional likelihood, all sentences side by side.

    All sentences are held by the driver: the labelled table is meant to be small (hundreds of sentences).
    """
    texts, spans = labelled(sentences)
    raw = [t.encode() for t in texts]
    found = shapes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64))
    gold = _gold(found, texts, spans)
    starts = np.flatnonzero(np.r_[True, found.row[1:] != found.row[:-1]])
    sizes = np.diff(np.r_[starts, len(gold)])
    longest = int(sizes.max())
    at = starts[:, None] + np.minimum(np.arange(longest), sizes[:, None] - 1)
    real = np.arange(longest) < sizes[:, None]
    places, label = features(found, np.arange(len(gold))), gold[at]
    weights = [np.zeros((OFFSETS[-1], LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros(LABELS)]
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    pick = lambda x: np.eye(LABELS)[x]
    seen_steps = np.einsum("bka,bkc->ac", pick(label[:, :-1]) * real[:, 1:, None], pick(label[:, 1:]))
    seen_first, seen_last = pick(label[:, 0]).sum(axis=0), pick(gold[starts + sizes - 1]).sum(axis=0)
    for turn in range(1, STEPS + 1):
        emission, step, first, last = weights
        emitted = emission[places].sum(axis=1)[at]
        total = lambda x, axis: (lambda m: np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis))(x.max(axis=axis, keepdims=True))
        forward = [first + emitted[:, 0]]
        for k in range(1, longest):
            now = total(forward[-1][:, :, None] + step, 1) + emitted[:, k]
            forward.append(np.where(real[:, k, None], now, forward[-1]))
        backward = [np.broadcast_to(last, forward[0].shape)]
        for k in range(longest - 1, 0, -1):
            now = total(step + (emitted[:, k] + backward[-1])[:, None, :], 2)
            backward.append(np.where(real[:, k, None], now, backward[-1]))
        backward = backward[::-1]
        whole = total(forward[-1] + last, 1)
        chance = np.stack([np.exp(f + b - whole[:, None]) for f, b in zip(forward, backward, strict=True)], 1)
        # the backward table of a word past the end repeats the last one, so chances of real words are right
        expected_step = np.zeros_like(step)
        for k in range(1, longest):
            joint = forward[k - 1][:, :, None] + step + (emitted[:, k] + backward[k])[:, None, :] - whole[:, None, None]
            expected_step += (np.exp(joint) * real[:, k, None, None]).sum(axis=0)
        error = np.zeros((len(gold), LABELS))
        error[at[real]] = chance[real]
        ends = error[starts + sizes - 1].sum(axis=0)
        starts_now = error[starts].sum(axis=0)
        error -= pick(gold)
        gradient = np.zeros_like(emission)
        for column in places.T:
            np.add.at(gradient, column, error)
        slopes = [gradient, expected_step - seen_steps, starts_now - seen_first, ends - seen_last]
        for w, slope, (m, v) in zip(weights, slopes, moment, strict=True):
            slope = slope / len(starts) + PENALTY * w
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            w -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights)


# --- spans -----------------------------------------------------------------------------------------------------------

_AT_WORD = re.compile(rb"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", re.I)
_DOT_WORD = re.compile(rb"\s*[(\[{]\s*(?:dot|punkt|punto|point)\s*[)\]}]\s*|\s+(?:dot|punkt|punto|point)\s+", re.I)
_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EDGES = {0: (rb"[^A-Za-z0-9]*", rb"[^A-Za-z0-9]*$"), 1: (rb"[^0-9]*", rb"[^0-9]*$"), 2: (rb"[^0-9]*", rb"[^0-9]*$"), 3: (rb"[^0-9+(]*", rb"[^0-9]*$")}
_TRIM = {k: (re.compile(a), re.compile(b)) for k, (a, b) in _EDGES.items()}
_LONGEST = 200  # bytes of a checked span: longer runs of words are no address or number


def _checked(raw: bytes, start: int, end: int, kind: int) -> tuple[int, int, int] | None:
    """The span without signs around it, if it is what the field takes it for."""
    if end - start > _LONGEST:
        return None
    head, tail = _TRIM[kind]
    start = head.match(raw, start, end).end()
    body = raw[start:end]
    body = body[: tail.search(body).start()]
    if not body:
        return None
    if kind == 0:
        plain = _DOT_WORD.sub(b".", _AT_WORD.sub(b"@", body))
        fits = _EMAIL.fullmatch(plain) is not None
    elif kind == 1:
        plain = re.sub(rb"[\[({]\.[\])}]", b".", body)
        fits = re.fullmatch(rb"[0-9]+(?:\.[0-9]+){3}", plain) is not None and _is_ip(plain)
    elif kind == 2:
        fits = re.fullmatch(rb"[0-9](?:[\x20.-]?[0-9])+", body) is not None and _is_card(body)
    else:
        fits = re.fullmatch(rb"[+(]{0,2}[0-9][\x20().0-9/-]*", body) is not None and _is_phone(body)
    return (start, kind, start + len(body)) if fits else None


def added_spans(field: Field, data: np.ndarray, found: Shapes, around: int | None, base: list[list[tuple[int, int, int]]], offsets: np.ndarray):
    """Per text the checked spans of the field that no pattern's span of their kind overlaps, as :func:`base_spans`."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in base]
    words, label = decode(field, found, around)
    hit = np.flatnonzero(label)
    k = 0
    while k < len(hit):
        first = last = hit[k]
        kind, row = (int(label[first]) - 1) // 2, int(found.row[words[first]])
        while k + 1 < len(hit):
            nxt = hit[k + 1]
            if words[nxt] != words[last] + 1 or found.row[words[nxt]] != row or label[nxt] != 2 * kind + 2:
                break
            last, k = nxt, k + 1
        k += 1
        begin = int(offsets[row])
        raw = data[found.start[words[first]] : found.end[words[last]]].tobytes()
        span = _checked(raw, 0, len(raw), kind)
        if span:
            low, high = (int(found.start[words[first]]) - begin + x for x in (span[0], span[2]))
            if all(b <= low or a >= high for a, other, b in base[row] if other == kind):
                out[row].append((low, kind, high))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` and ``n_added``.

    The counts and the digest are of the patterns' spans, ``spans`` holds these and the ``n_added`` ones of the field, as
    ``kind:start:end`` in code points by start and kind. Null and empty texts have none (the digest of an empty string).
    Repeated rows and ids are texts of their own; empty tables give empty results; other columns don't matter. Texts are
    read whole; memory grows with the longest text.
    """
    known = docs.sparkSession.sparkContext.broadcast((field, field.around()))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        field, around = known.value
        data, offsets = tokens.buffers(batch.column(1))
        counts, digests, spans, more = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], [], []
        for low, high in tokens.row_groups(offsets):
            part, piece = offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]]
            found = shapes(piece, part)
            rows = np.zeros(high - low, bool)
            rows[found.row[found.special]] = True
            base = [base_spans(piece[part[k] : part[k + 1]].tobytes()) if rows[k] else [] for k in range(high - low)]
            added = added_spans(field, piece, found, around, base, part)
            begins = np.cumsum((piece & 0xC0) != 0x80) if any(base) or any(added) else None
            for k in range(high - low):
                texts = []
                for own in (base[k], [*base[k], *added[k]]):
                    if own and begins is not None:
                        before = int(begins[part[k]]) - 1
                        # a span's ends stand at the beginnings of characters or at the end of the text
                        place = lambda x, k=k, before=before: int(begins[part[k] + x - 1]) - before if x else 0
                        own = [(place(a), kind, place(b)) for a, kind, b in own]
                    texts.append(_written(own))
                for _, number, _ in base[k]:
                    counts[low + k, number] += 1
                digests.append(hashlib.sha256(texts[0].encode()).hexdigest())
                spans.append(texts[1])
                more.append(len(added[k]))
        columns = [batch.column(0), *(pa.array(counts[:, j]) for j in range(len(KINDS))), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string()), pa.array(more, pa.int64())], names)

    schema = f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return over_batches(texts, work, schema).withColumnRenamed("_id", id_col)


def op11_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit_field(EXAMPLES))
