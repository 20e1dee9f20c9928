"""Language ID by cross-parsing: the language whose text parses a document into the fewest phrases.

A suffix automaton of each language's sample recognises exactly the sample's substrings.
Parsing greedily, each phrase is the longest match from where the last one ended; phrases
times log2(sample length) over the document's length is its cross entropy under the language.
The automata are tables, so that a batch's texts are parsed side by side in numpy, and a long
text in blocks side by side: each block is parsed as if a phrase began there, then again from
the state in which the block before it ends, as far as the two parses differ (a few letters,
as a rule), until every block begins as the one before it ends. That is the whole text's parse.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, in_arrow, table

#: Characters of sample text for each language, and of one excerpt.
TRAIN_CHARS, EXCERPT = 24_000, 500
#: Characters of sample text of all languages together: with many languages, each has less. The bound of what is
#: broadcast: a sparse table has three entries of 16 bytes for each of them at most.
TOTAL_CHARS = 1_500_000
#: Entries of all automata's dense tables together; beyond that they are sparse, which is slower.
DENSE = 1 << 24
#: A text is parsed in blocks of so many normalised characters, and again from the right states so many times
#: side by side; texts that still differ then (such as one syllable, thousands of times) are parsed letter by letter.
BLOCK, AGAIN = 512, 6
MAX_LANGUAGES = 256
#: Characters that are parsed side by side (one text at least): a worker's memory grows with it.
TOGETHER = 500_000


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalise(texts: list[str | None], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, each text's length in codes, its letters): lower case, runs of other characters as one gap (0)."""
    low = [(t or "").lower() for t in texts]
    n = np.fromiter(map(len, low), np.int64, len(low))
    flat = code[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(n)
    starts = ends - n
    keep = flat != 0
    letters = np.concatenate([[0], np.cumsum(keep)])
    letters = letters[ends] - letters[starts]
    keep[1:] |= flat[:-1] != 0
    keep[starts[n > 0]] = True  # a gap at the start is kept, so every text's parse begins alike
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[ends] - kept[starts], letters


class Automaton:
    """The suffix automaton of one language's sample as a table for greedy parsing.

    go[state * letters + c] is 4 * (next state * letters) + phrases ended by c: 0 where the
    match goes on, 1 where a new phrase starts with c, 2 where c itself is in no sample.
    A sparse table holds only the entries of matches that go on; the others are root's.
    """

    def __init__(self, sample: np.ndarray, letters: int, dense: bool = True):
        nxt, link, size = [{}], [-1], [0]
        last = 0
        for c in sample.tolist():
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        root = np.full(letters, 2, np.int32 if dense else np.int64)
        for c, t in nxt[0].items():
            root[c] = 4 * t * letters + 1
        self.bits = float(np.log2(max(2, len(sample))))
        state = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
        c = np.fromiter((c for x in nxt for c in x), np.int64, len(state))
        t = np.fromiter((t for x in nxt for t in x.values()), np.int64, len(state))
        self.root, self.letters, self.go = root, letters, None
        if dense:
            self.go = np.tile(root, len(nxt))
            self.go[state * letters + c] = 4 * t * letters
            self.go[:letters] -= (self.go[:letters] == 2).astype(np.int32)  # at the root no phrase is open
            return
        inner = state > 0
        keys, to = np.concatenate([np.arange(letters), state[inner] * letters + c[inner]]), np.concatenate([root - 1, 4 * t[inner] * letters])
        order = np.argsort(keys)  # at the root no phrase is open, so its entries count one less
        self.keys, self.to = keys[order], to[order]

    def step(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The table's entries at states (times letters) and codes."""
        if self.go is not None:
            return self.go.take(at + c)
        k = np.minimum(np.searchsorted(self.keys, at + c), len(self.keys) - 1)
        return np.where(self.keys[k] == at + c, self.to[k], self.root[c])

    def whole(self, codes: np.ndarray) -> int:
        """The phrases of one text, letter by letter."""
        at = n = 0
        if self.go is not None:
            go = memoryview(self.go)
            for c in codes.tolist():
                v = go[at + c]
                n += v & 3
                at = v >> 2
        else:
            go, root = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.root.tolist()
            for c in codes.tolist():
                v = go.get(at + c, root[c])
                n += v & 3
                at = v >> 2
        return n + (at > 0)


class Blocks:
    """Texts in blocks, longest first, so that the blocks that go on are always a front part."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.n, self.begin = flat, n, np.cumsum(n) - n
        blocks = -(-n // BLOCK)
        text = np.repeat(np.arange(len(n)), blocks)
        k = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(BLOCK, n[text] - k * BLOCK)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(k > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)
        self.text, self.size, self.before = text[order], size[order], before[order]
        self.last = np.ones(len(order), bool)
        self.last[before[before >= 0]] = False
        start = self.begin[self.text] + k[order] * BLOCK
        active = np.searchsorted(-self.size, -np.arange(1, self.size[0] + 1), side="right") if len(size) else []
        padded = np.append(flat, np.zeros(BLOCK, flat.dtype))
        self.columns = [padded[start[:a] + j].astype(np.int32) for j, a in enumerate(active)]

    def phrases(self, x: Automaton) -> np.ndarray:
        """Phrases of each text in x's greedy parse."""
        end, total = np.zeros(len(self.size), x.root.dtype), np.zeros(len(self.size), np.int64)
        states, ended = [], []
        for c in self.columns:
            v = x.step(end[: len(c)], c)
            new = (v & 3).astype(np.uint8)
            end[: len(c)] = to = v >> 2
            total[: len(c)] += new
            states.append(to)
            ended.append(new)
        entry = np.zeros_like(end)
        wrong = lambda: np.flatnonzero((self.before >= 0) & (entry != end[self.before]))
        lanes = wrong()
        for _ in range(AGAIN):
            if not len(lanes):
                break
            entry[lanes] = end[self.before[lanes]]
            self._again(x, lanes, entry[lanes], states, ended, end, total)
            lanes = wrong()
        out = np.bincount(self.text, total + (self.last & (end > 0)), minlength=len(self.n)).astype(np.int64)
        for t in np.unique(self.text[lanes]).tolist():
            out[t] = x.whole(self.flat[self.begin[t] : self.begin[t] + self.n[t]])
        return out

    def _again(self, x: Automaton, lanes: np.ndarray, state: np.ndarray, states: list, ended: list, end: np.ndarray, total: np.ndarray) -> None:
        """Parse some blocks from other states, each until it is in the state that it was in before after the same letter."""
        left = np.arange(len(lanes))
        met = np.zeros(len(lanes), bool)
        for j, c in enumerate(self.columns):
            left = left[self.size[lanes[left]] > j]
            if not len(left):
                break
            at = lanes[left]
            v = x.step(state[left], c[at])
            new, to = (v & 3).astype(np.uint8), v >> 2
            total[at] += new.astype(np.int64) - ended[j][at]
            same = to == states[j][at]
            ended[j][at], states[j][at], state[left] = new, to, to
            met[left[same]] = True
            left = left[~same]
        end[lanes[~met]] = state[~met]


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        """samples: excerpts of text by language."""
        seen: Counter = Counter()
        for texts in samples.values():
            seen.update(Counter(c for t in texts for c in t.lower() if c.isalpha()))
        self.alphabet = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.langs = sorted(samples)
        code, letters = self.code(), len(self.alphabet) + 2
        parts = [normalise(["\n".join(samples[lang])], code)[0] for lang in self.langs]
        dense = 2 * sum(map(len, parts)) * letters <= DENSE  # an automaton has two states for each code at most
        self.automata = [Automaton(x, letters, dense) for x in parts]

    def code(self) -> np.ndarray:
        """Of a code point: 0 no letter, 1 a letter of no sample, else its place in the alphabet + 2."""
        kind = np.uint8 if len(self.alphabet) < 254 else np.int32
        out = _is_letter().astype(kind)
        out[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet), dtype=kind) + 2
        return out

    def phrases(self, texts: list[str | None], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, normalised lengths, letters)."""
        flat, n, letters = normalise(texts, code)
        blocks = Blocks(flat, n)
        return np.stack([blocks.phrases(x) for x in self.automata], axis=1), n, letters

    def predict(self, texts: list[str | None], code: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, cross entropies in bits a character)."""
        counts, n, letters = self.phrases(texts, code)
        bits = counts * np.array([a.bits for a in self.automata])
        best = np.argmin(bits, axis=1)
        low = bits[np.arange(len(n)), best]
        # the posterior of the shortest code, one power of two for each phrase
        score = 1 / np.exp2(np.maximum((low[:, None] - bits) / self.automata[0].bits, -60)).sum(axis=1)
        none = letters == 0
        return ["und" if x else self.langs[k] for x, k in zip(none, best, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, low / np.maximum(n, 1))


def fit(docs: DataFrame, train: object, train_chars: int = TRAIN_CHARS) -> Model:
    """A model from at most train_chars characters for each language (TOTAL_CHARS for all), in excerpts of 500.

    train: the condition on rows to learn from. Rows with null text or lang are left out. Which
    rows are read, and where in the text an excerpt starts, goes by hashes, so at any size the
    driver gets a few hundred excerpts for each language. More than 256 languages is an error.
    """
    rows = docs.where(train).where("lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    train_chars = max(EXCERPT, min(train_chars, TOTAL_CHARS // max(1, len(counts))))
    need = -(-train_chars // EXCERPT)
    rate = F.lit(1.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 6 * need / n))).otherwise(rate)
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    at = F.lit(1) + F.pmod(h, F.greatest(F.char_length("text") - EXCERPT, F.lit(1))).cast("int")
    got = rows.where(F.pmod(h, F.lit(1 << 20)) < rate * (1 << 20)).where("text is not null").select("lang", F.substring(F.col("text"), at, F.lit(EXCERPT)).alias("x"), h.alias("h")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["h"], r["x"])):
        texts = samples.setdefault(r["lang"], [])
        if any(c.isalpha() for c in r["x"]) and sum(map(len, texts)) < train_chars:
            texts.append(r["x"])
    return Model({k: v for k, v in samples.items() if v})


OUT = "doc_id long, lang_pred string, score double, bits double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and bits (cross entropy a character) of every row's whole text.

    Null text, or text without a letter, is `und` with score 0; ties go to the language that
    sorts first; repeated rows each give a row; a null doc_id stays null. A model that saw no
    text calls everything `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DENSE entries of 4 bytes, or TOTAL_CHARS in sparse tables, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        code = m.code()
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                if m.langs:
                    lang, score, bits = m.predict(texts[at:end], code)
                else:
                    lang, score, bits = ["und"] * (end - at), np.zeros(end - at), np.zeros(end - at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])
                at = end

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, OUT)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose language can be told; a null lang becomes the prediction.

    Rows that `identify` calls `und` go: null or empty text, or text without a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        code = m.code()
        for b in batches:
            texts = b.column("text").to_pylist()
            keep, lang, at = [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                got = m.predict(texts[at:end], code)[0] if m.langs else ["und"] * (end - at)
                lang += got
                at = end
            keep = [x != "und" for x in lang]
            had = b.column("lang").to_pylist()
            cols = [pa.array([h if h is not None else x for h, x in zip(had, lang, strict=True)], pa.string()) if c == "lang" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold(F.col("doc_id"), 3) != 1)
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits")
