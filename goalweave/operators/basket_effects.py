"""What a part of a basket's edit log does to any basket it may meet, in two steps. Runs in Python workers.

**Patterns.** A fund is ABSENT, in the basket at ZERO weight, or POSITIVE. A part of a log is described by *cases*: boxes of
first patterns that exclude each other and cover all, each with the outcome per fund. A fund's share of a case is one
small number that holds the outcome of its three first states, or OUT where the case does not hold. Edits only split
a case where the outcome hangs on a fund not known yet, and cases that differ in one fund are put together again.
Following a log is a walk from one list of cases to the next; steps are remembered, so a long log is a chain of look-ups.

**Weights.** Once the pattern is known, an edit is linear up to scale ("w percent for fund f, others pro rata" leaves the
others alone and gives f ``w / (100 - w)`` of their sum) or leaves a known basket (nothing to scale: evenly; all in
one fund). A part of a log is a matrix with a scale for each column, or a known basket; both multiply.
"""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, PRESET, WEIGHT, ADD, REMOVE = range(5)
#: Weights of 0, between, and of 100 act on patterns in different ways.
ALL_IN, NOTHING = 5, 6

ABSENT, ZERO, POSITIVE, OUT = range(4)
STATES = (ABSENT, ZERO, POSITIVE)
Case = tuple[int, ...]


# ---- patterns


def _code(images) -> int:
    return sum(image << 2 * s for s, image in zip(STATES, images))


def _images(code: int) -> list[int]:
    return [code >> 2 * s & 3 for s in STATES]


EMPTY = _code([OUT] * 3)
SAME = _code(STATES)
CODES = range(64)


def _only(*states: int) -> list[int]:
    """Each code without the first states that do not end in these."""
    return [_code(i if i in states else OUT for i in _images(c)) for c in CODES]


def _moved(*to: int) -> list[int]:
    """Each code with ends moved: where ABSENT, ZERO and POSITIVE go."""
    return [_code(i if i == OUT else to[i] for i in _images(c)) for c in CODES]


IS_ABSENT, IS_HELD, IS_POSITIVE, NOT_POSITIVE, IS_ZERO = _only(ABSENT), _only(ZERO, POSITIVE), _only(POSITIVE), _only(ABSENT, ZERO), _only(ZERO)
TO_POSITIVE, TO_ZERO, TO_ABSENT = _moved(POSITIVE, POSITIVE, POSITIVE), _moved(ZERO, ZERO, ZERO), _moved(ABSENT, ABSENT, ABSENT)
HELD_TO_POSITIVE, HELD_TO_ZERO = _moved(ABSENT, POSITIVE, POSITIVE), _moved(ABSENT, ZERO, ZERO)
COMPOSED = [[_code(OUT if i == OUT else _images(b)[i] for i in _images(a)) for b in CODES] for a in CODES]


def unchanged(n_funds: int) -> tuple[Case, ...]:
    return ((SAME,) * n_funds,)


def _some(case: Case, funds, holds: list[int], fails: list[int]):
    """The case where any of the funds passes ``holds``, in parts: the first that does, the ones before it fail."""
    for k, g in enumerate(funds):
        part = list(case)
        for earlier in funds[:k]:
            part[earlier] = fails[part[earlier]]
        part[g] = holds[part[g]]
        if EMPTY not in part:
            yield part


def _all(case: Case, funds, holds: list[int]):
    part = list(case)
    for g in funds:
        part[g] = holds[part[g]]
    if EMPTY not in part:
        yield part


def _after(case: Case, kind: int, f: int):
    """What a case becomes by one edit: one or several cases."""
    others = [g for g in range(len(case)) if g != f]
    absent, held = IS_ABSENT[case[f]], IS_HELD[case[f]]
    acted, idle = (absent, held) if kind == ADD else (held, absent)
    if idle != EMPTY:
        yield (*case[:f], idle, *case[f + 1 :])
    if acted == EMPTY:
        return
    case = (*case[:f], acted, *case[f + 1 :])

    def ended(part: list[int], mine: list[int], rest: list[int] | None = None) -> Case:
        return tuple(mine[c] if g == f else c if rest is None else rest[c] for g, c in enumerate(part))

    if kind == ALL_IN:
        yield ended(list(case), TO_POSITIVE, HELD_TO_ZERO)
        return
    # Nothing else to scale: a removal empties the basket, anything else goes evenly to the others.
    for part in _all(case, others, NOT_POSITIVE):
        if kind == REMOVE:
            yield ended(part, TO_ABSENT, TO_ABSENT)
        elif kind == NOTHING:
            for alone in _all(part, others, IS_ABSENT):
                yield ended(alone, TO_POSITIVE)
            for company in _some(part, others, IS_ZERO, IS_ABSENT):
                yield ended(company, TO_ZERO, HELD_TO_POSITIVE)
        else:
            yield ended(part, TO_POSITIVE, HELD_TO_POSITIVE)
    mine = {REMOVE: TO_ABSENT, NOTHING: TO_ZERO}.get(kind, TO_POSITIVE)
    for part in _some(case, others, IS_POSITIVE, NOT_POSITIVE):
        yield ended(part, mine)


def merged(cases) -> tuple[Case, ...]:
    """Cases that differ in one fund alone become one."""
    cases, before = set(cases), None
    while before != len(cases):
        before = len(cases)
        for g in range(len(next(iter(cases)))):
            together: dict = {}
            for c in cases:
                rest = (c[:g], c[g + 1 :])
                # OUT is all ones, and the first states of such cases differ.
                together[rest] = together.get(rest, EMPTY) & c[g]
            if len(together) < len(cases):
                cases = {(*a, code, *b) for (a, b), code in together.items()}
    return tuple(sorted(cases))


_STEPS: dict = {}


def edited_cases(cases: tuple[Case, ...], columns) -> tuple[Case, ...]:
    """Follow edits (kind, fund, weight, basket) in order."""
    kinds, funds, weights, baskets = columns
    with np.errstate(invalid="ignore"):
        kinds = np.where(kinds == WEIGHT, np.where(weights >= 100, ALL_IN, np.where(weights <= 0, NOTHING, WEIGHT)), kinds)
    for k, (kind, f) in enumerate(zip(kinds.tolist(), funds.tolist())):
        if kind <= PRESET:
            given = baskets[k]
            cases = (tuple(_code([ABSENT if math.isnan(w) else POSITIVE if w > 0 else ZERO] * 3) for w in given.tolist()),)
            continue
        step = cases, kind, f
        found = _STEPS.get(step)
        if found is None:
            if len(_STEPS) > 200_000:
                _STEPS.clear()
            found = _STEPS[step] = merged(after for c in cases for after in _after(c, kind, f))
        cases = found
    return cases


def packed_cases(cases: tuple[Case, ...]) -> bytes:
    return bytes(itertools.chain.from_iterable(cases))


def unpacked_cases(raw: bytes, n_funds: int) -> tuple[Case, ...]:
    return tuple(tuple(raw[k : k + n_funds]) for k in range(0, len(raw), n_funds))


def composed_cases(parts: list[tuple[Case, ...]], n_funds: int) -> tuple[Case, ...]:
    """One list of cases for parts of a log that follow each other."""
    so_far = unchanged(n_funds)
    for part in parts:
        pairs = (tuple(COMPOSED[a][b] for a, b in zip(x, y)) for x in so_far for y in part)
        so_far = merged(p for p in pairs if EMPTY not in p)
    return so_far


def outcome(cases: tuple[Case, ...], pattern: bytes) -> bytes:
    for case in cases:
        ends = [code >> 2 * s & 3 for code, s in zip(case, pattern)]
        if OUT not in ends:
            return bytes(ends)
    raise ValueError("no case holds")


def patterns_along(pattern: bytes, parts: list[tuple[Case, ...]]) -> list[bytes]:
    """The pattern before each part."""
    found = []
    for part in parts:
        found.append(bytes(pattern))
        pattern = outcome(part, pattern)
    return found


def pattern_of(basket) -> bytes:
    return bytes(ABSENT if w is None or math.isnan(w) else POSITIVE if w > 0 else ZERO for w in basket)


def basket_of(pattern: bytes) -> list[float | None]:
    """Any basket of this pattern."""
    return [{ABSENT: None, ZERO: 0.0, POSITIVE: 1.0}[s] for s in pattern]


# ---- weights

RESCALE_EVERY = 16
AS_IT_WAS, EDITED, AS_GIVEN = range(3)


class WeightEffect:
    """What a part of a log does to any basket of a known pattern.

    ``images[:, k]`` times ``exp(log_scale[k])`` is what a unit of fund k turns into. A single column without a start
    (``known``) is the basket itself. ``touched`` is AS_IT_WAS while no edit has acted and AS_GIVEN from a preset to the next
    edit that acts: weights then stay, whatever they add up to. Weights are not negative.
    """

    def __init__(self, basket: np.ndarray):
        n = len(basket)
        self.held = {k for k in range(n) if not math.isnan(basket[k])}
        self.positive = {k for k in self.held if basket[k] > 0}
        self.touched, self.known = AS_IT_WAS, False
        self.images = np.diag([1.0 if k in self.positive else 0.0 for k in range(n)])
        self.log_scale, self.steps = np.zeros(n), 0

    def preset(self, basket: np.ndarray) -> None:
        self.__init__(basket)
        self.touched, self.known = AS_GIVEN, True
        self.images = np.nan_to_num(basket).reshape(-1, 1)
        self.log_scale = np.zeros(1)

    def _know(self, weights: dict[int, float]) -> None:
        self.known = True
        self.images, self.log_scale = np.zeros((len(self.images), 1)), np.zeros(1)
        for f, w in weights.items():
            self.images[f, 0] = w
        self.positive = {f for f, w in weights.items() if w > 0}

    def edit(self, kind: int, f: int, w: float) -> None:
        if (f in self.held) == (kind == ADD):
            return
        self.touched = EDITED
        others = self.held - {f}
        if kind == REMOVE:
            if self.positive - {f}:
                self.images[f] = 0.0
                self.held, self.positive = others, self.positive - {f}
            else:
                self.held = set()
                self._know({})
        elif kind == ADD:
            n = len(self.held)
            self.held = others | {f}
            if self.positive:
                self.images[f] = self.images.sum(axis=0) / n
                self.positive = self.positive | {f}
            else:
                self._know(dict.fromkeys(self.held, 100.0 / (n + 1)))
        elif not others:
            self._know({f: 100.0})
        elif w >= 100.0:
            self._know(dict.fromkeys(others, 0.0) | {f: 100.0})
        elif not self.positive - {f}:
            w = max(w, 0.0)
            self._know(dict.fromkeys(others, (100.0 - w) / len(others)) | {f: w})
        else:
            w = max(w, 0.0)
            self.images[f] = 0.0
            self.images[f] = self.images.sum(axis=0) * (w / (100.0 - w))
            self.positive = self.positive | {f} if w > 0 else self.positive - {f}
        self.steps += 1
        if self.steps % RESCALE_EVERY == 0:
            self.images, self.log_scale = _rescaled(self.images, self.log_scale)

    def packed(self) -> list[float]:
        n = len(self.images)
        held = [1.0 if k in self.held else 0.0 for k in range(n)]
        return [float(self.touched), float(self.known), *held, *self.log_scale.tolist(), *self.images.ravel().tolist()]


def edited_weights(effect: WeightEffect | None, columns, n_funds: int) -> WeightEffect:
    """Follow edits (kind, fund, weight, basket) in order; the first one gives the pattern."""
    kinds, funds, weights, baskets = columns
    if effect is None:
        effect = WeightEffect(np.full(n_funds, np.nan))
    for k, (kind, f, w) in enumerate(zip(kinds.tolist(), funds.tolist(), weights.tolist())):
        if kind == START:
            effect = WeightEffect(baskets[k])
        elif kind == PRESET:
            effect.preset(baskets[k])
        else:
            effect.edit(kind, f, w)
    return effect


def _rescaled(images: np.ndarray, log_scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column's largest entry at 1; columns of zeros stay."""
    top = images.max(axis=0, initial=0.0)
    top = np.where(top > 0, top, 1.0)
    return images / top, log_scale + np.log(top)


def _parts(packed, n: int):
    packed = np.asarray(packed, dtype=float)
    known = bool(packed[1])
    columns = 1 if known else n
    held, log_scale = packed[2 : 2 + n], packed[2 + n : 2 + n + columns]
    return int(packed[0]), known, held, log_scale, packed[2 + n + columns :].reshape(n, columns)


def _times(first, second):
    """The second effect after the first; both as ``_parts`` gives them."""
    if second[0] == AS_IT_WAS:
        return first
    if second[1] or first[0] == AS_IT_WAS:
        return second
    _, known, _, scale, images = first
    _, _, held, later_scale, later = second
    logs = np.where(images > 0, later_scale[:, None], -np.inf)
    top = logs.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(invalid="ignore"):
        weighed = np.where(images > 0, images * np.exp(logs - top), 0.0)
    images, scale = _rescaled(later @ weighed, scale + top)
    return EDITED, known, held, scale, images


def product(packed: list, n_funds: int) -> list[float]:
    """One effect for parts of a log that follow each other."""
    parts = [_parts(p, n_funds) for p in packed]
    so_far = parts[0]
    for part in parts[1:]:
        so_far = _times(so_far, part)
    touched, known, held, scale, images = so_far
    return [float(touched), float(known), *held.tolist(), *scale.tolist(), *images.ravel().tolist()]


def applied(basket, packed, n_funds: int) -> list[float | None]:
    """Weights after an effect, None for funds that are not held."""
    effect = _parts(packed, n_funds)
    touched, known, held, _, images = effect
    x = np.array([np.nan if w is None else w for w in basket], dtype=float)
    if touched == AS_IT_WAS:
        return [None if math.isnan(w) else w for w in x.tolist()]
    if not known:
        start = np.nan_to_num(x).reshape(-1, 1)
        images = _times((EDITED, True, held, np.zeros(1), np.where(start > 0, start, 0.0)), effect)[4]
    y = images[:, 0]
    total = y.sum()
    if touched == EDITED and total > 0:
        y = y / total * 100.0
    return [w if h else None for w, h in zip(y.tolist(), held.tolist())]
