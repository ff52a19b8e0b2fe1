"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into
the longest matches with each automaton; the language that needs the fewest phrases per character, each weighed by the
logarithm of the sample's length, wins. Automata know
every character of the samples and hold existing transitions only, in rows displaced into each other's gaps. A worker
parses all texts of a batch together, a character of each at a time; long texts are parsed in windows that run side by
side, whose phrases are then put right across their borders.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Bounds of the training sample: whole texts a language, the characters after which no further text is taken, and those
#: of all languages together. Beyond the last, each language has fewer texts, one at least.
SAMPLE_DOCS = 100
SAMPLE_CHARS = 100_000
SAMPLE_TOTAL = 32 * SAMPLE_CHARS
#: Characters of texts that are taken first.
HANDY = (400, 1600)
#: Characters of a window, several of which are parsed side by side.
WINDOW = 512
#: Texts parsed together.
SLICE = 500
UNDETERMINED = "und"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is divisible by folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _fold(text: str) -> str:
    """Lower case, white space to single blanks."""
    return " ".join(text.lower().split())


@dataclass
class Automaton:
    """Transitions of states (0 is the root): that of state s by c is to[base[s] + c] if check[base[s] + c] is s."""

    base: np.ndarray
    to: np.ndarray
    check: np.ndarray

    def __getitem__(self, place: tuple[int, int]) -> int:
        """The state that a state reaches by a code; -1 for none."""
        at = int(self.base[place[0]]) + place[1]
        return int(self.to[at]) if self.check[at] == place[0] else -1


def _displaced(follow: list[dict[int, int]], width: int) -> Automaton:
    """follow as an automaton: states of many transitions are laid out first, those of one fill the gaps."""
    base = np.zeros(len(follow), np.int32)
    used, hint = bytearray(2 * width), width  # no base is negative
    order = sorted((s for s in range(len(follow)) if follow[s]), key=lambda s: -len(follow[s]))
    single = next((i for i, s in enumerate(order) if len(follow[s]) == 1), len(order))
    for i, state in enumerate(order):
        if i == single:
            hint = width
        keys = sorted(follow[state])
        while True:
            if len(used) < hint + width:
                used.extend(bytes(len(used) + width))
            hint = used.index(0, hint)
            if len(used) < hint + width:
                continue
            start = hint - keys[0]
            if not any(used[start + k] for k in keys[1:]):
                break
            hint += 1
        base[state] = start
        for k in keys:
            used[start + k] = 1
    size = int(base.max(initial=0)) + width
    to, check = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for state in order:
        start = int(base[state])
        for c, reached in follow[state].items():
            to[start + c], check[start + c] = reached, state
    return Automaton(base, to, check)


def automaton(codes: list[int], width: int) -> Automaton:
    """The suffix automaton of codes below width."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return _displaced(follow, width)


@dataclass
class Model:
    """Languages, the class of each code point below len(classes), and the automata one behind the other."""

    langs: list[str]
    classes: np.ndarray  # the last is that of all code points beyond
    table: Automaton
    roots: np.ndarray
    weights: np.ndarray  # bits that name a place in a language's sample, which a phrase costs

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, characters by text): a greedy parse of the whole text from its start.

        Windows of a text are parsed side by side, each as if a phrase began with it. Then those that a phrase reaches
        into are parsed again from the state it brings, till they are in the state of the first parse, as soon happens;
        a window that never is changes what it brings to the next one, which is parsed again in turn.
        """
        folded = [_fold(t) for t in texts]
        sizes = np.array([len(t) for t in folded], np.int64)
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.classes[np.minimum(points, len(self.classes) - 1)]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // WINDOW))
        if not len(owner):
            return found, sizes
        first = np.concatenate([np.arange(s, e, WINDOW) for s, e in zip(ends - sizes, ends, strict=True)])
        span = np.minimum(WINDOW, ends[owner] - first)
        order = np.argsort(-span, kind="stable")  # windows that end drop off the tail
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # The window before in the same text, as a place in order; a text's first window has none.
        before = np.where(np.concatenate([[False], owner[1:] == owner[:-1]]), np.concatenate([[0], rank[:-1]]), -1)[order]
        closing = np.concatenate([owner[1:] != owner[:-1], [True]])[order]
        first, span, owner = first[order], span[order], owner[order]
        every = np.arange(len(order))
        for k, root in enumerate(self.roots.tolist()):
            states = np.empty((WINDOW, len(order)), np.int32)
            counts = np.zeros((WINDOW, len(order)), np.int8)
            brought = np.full(len(order), root, np.int64)
            self._parse(root, codes, first, span, None, brought, states, counts)
            while True:
                last = states[span - 1, every].astype(np.int64)
                now = np.where(before >= 0, last[before], root)
                again = np.flatnonzero(now != brought)
                if not len(again):
                    break
                brought = now
                self._parse(root, codes, first, span, again, now, states, counts)
            np.add.at(found[:, k], owner, counts.sum(axis=0, dtype=np.int64) + (closing & (last != root)))
        return found, sizes

    def _parse(self, root: int, codes, first, span, lanes, start, states, counts) -> None:
        """Parse all windows, longest first, or those of lanes till they are in the state they had there, from start.

        states gets the state after each character, counts the phrases that end there. A character that the sample
        lacks counts as two: one more to name it.
        """
        base, reached, check = self.table.base, self.table.to, self.table.check
        held, state = slice(None), start if lanes is None else start[lanes]
        live = np.searchsorted(-span, -np.arange(WINDOW), side="left")  # windows longer than i
        for i in range(WINDOW):
            if lanes is None:
                n = int(live[i])
                held, state = slice(n), state[:n]
            else:
                on = span[lanes] > i
                lanes, state = lanes[on], state[on]
                held, n = lanes, len(lanes)
            if not n:
                return
            c = codes[first[held] + i]
            at = base[state] + c
            to = reached[at]
            broken = check[at] != state
            ended = np.zeros(n, np.int8)
            if broken.any():
                from_root = base[root] + c[broken]
                known = check[from_root] == root
                to[broken] = np.where(known, reached[from_root], root)
                ended[broken] = (state[broken] != root).astype(np.int8) + 2 * ~known
            if lanes is not None:
                apart = states[i, held] != to
            states[i, held], counts[i, held], state = to, ended, to
            if lanes is not None:
                lanes, state = lanes[apart], to[apart]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, characters a phrase) of each text; the score is the winner's lead over the next."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        if not self.langs or not known:
            return out
        found, sizes = self.phrases([texts[i] for i in known])
        rate = found * self.weights / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(axis=1)
        for i, row, b, size in zip(known, rate, best.tolist(), sizes.tolist(), strict=True):
            others = np.delete(row, b)
            lead = 1.0 - row[b] / others.min() if len(others) and others.min() > 0 else 1.0 if not len(others) else 0.0
            out[i] = (self.langs[b], min(1.0, max(0.0, float(lead))), float(size / max(1, round(row[b] * size / self.weights[b]))))
        return out


def build(samples: dict[str, list[str]]) -> Model:
    """A model of {language: texts}, languages in order of name."""
    langs = sorted(samples)
    folded = {x: [_fold(t) for t in samples[x]] for x in langs}
    counts = Counter("".join("".join(t) for t in folded.values()))
    known = sorted(counts, key=lambda c: (-counts[c], c))
    # Class len(known) is of characters that no sample has, the next parts the texts of a sample; no text to parse has it.
    classes = np.full(max(map(ord, known), default=-1) + 2, len(known), np.int32)
    for i, c in enumerate(known):
        classes[ord(c)] = i
    width = len(known) + 2
    parts, roots, states, slots = [], [], 0, 0
    weights = np.log2([2 + sum(map(len, folded[x])) for x in langs]) if langs else np.zeros(0)
    for x in langs:
        own = automaton([k for t in folded[x] for k in [*(int(classes[ord(c)]) for c in t), width - 1]], width)
        parts.append((own.base + slots, np.where(own.to < 0, -1, own.to + states), np.where(own.check < 0, -1, own.check + states)))
        roots.append(states)
        states += len(own.base)
        slots += len(own.to)
    table = Automaton(*(np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int32) for i in range(3)))
    return Model(langs, classes, table, np.array(roots, np.int64), weights)


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """A model of the labelled rows outside the held-out fold.

    Of each language it takes whole texts, those of HANDY sizes first, in order of a hash of id and text: SAMPLE_DOCS at
    most, that have SAMPLE_CHARS characters together at most; fewer if there are over 32 languages. A text that no longer
    fits is passed over, and if none fits the shortest is taken. This bounds what the driver and the workers hold. Null ids hash like any other; equal rows count once. Empty table, or no labelled row:
    a model without languages, which determines nothing.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & text.isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), F.length(text).alias("size"), text.alias("text")
    )
    handy = F.when(F.col("size").between(*HANDY), 0).otherwise(1)  # many such texts say more of a language than a few long ones
    least = F.row_number().over(Window.partitionBy("lang").orderBy(handy, "h"))  # a rank limit, applied before the shuffle too
    ranked = rows.select("lang", "h", "size").dropDuplicates(["lang", "h"]).withColumn("place", least).where(F.col("place") <= SAMPLE_DOCS)
    places: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.orderBy("lang", "place").collect():  # SAMPLE_DOCS short rows a language
        places.setdefault(r["lang"], []).append((r["h"], r["size"]))
    most = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(1, len(places)))
    wanted = []
    for lang, held in places.items():
        total, own = 0, []
        for h, size in held:
            if total + size <= most:
                own.append((lang, h))
                total += size
        wanted += own or [(lang, min(held, key=lambda x: x[1])[0])]
    picked = docs.sparkSession.createDataFrame(wanted, "lang string, h long")
    samples: dict[str, list[str]] = {}
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")  # texts that the bounds picked
    for lang, text in sorted((r["lang"], r["text"]) for r in texts.collect()):
        samples.setdefault(lang, []).append(text)
    return build(samples)


def _predict(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, SLICE):
            out = model.predict(part["text"].to_pylist())
            arrays = [pa.array([o[0] for o in out], pa.string()), *(pa.array([o[i] for o in out], pa.float64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*(part[n] for n in names), *arrays], [*names, "lang_pred", "score", "phrase_chars"])

    return run


def identify(docs: DataFrame, model: Model, *, text_col="text") -> DataFrame:
    """row (struct of docs' columns but text), text, lang_pred, score, phrase_chars for each row of docs.

    Null texts and texts without a letter get und and score 0; so does every text if no language was learned. Only the
    text is read for a prediction. Ties go to the language first in order of name. Other columns ride along in row.
    """
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(others, F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared, ["row", "text"]), f"row {kind}, text string, lang_pred string, score double, phrase_chars double")
