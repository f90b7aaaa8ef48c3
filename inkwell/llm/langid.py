"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language yields the longest match at
each point of a text; cutting the text into such matches gives phrases. A
phrase costs log2(size of the language's training text) bits, and the language
that spells the text with the fewest bits wins.

Texts are folded to lower-case letters, every other run being one blank, and
parsed whole, in pieces of ``PIECE`` symbols that each begin a new phrase. Many
pieces step through the automata together, as one numpy table lookup a symbol.

Bound of the fitted sample (a parameter): ``train_rows`` rows a language in the
order of hashes of the id and the text (rows equal in both count once), and ``train_chars`` folded symbols of them.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
with no labelled row every text is ``und``; equal costs go to the smaller
language name; repeated rows are predicted one by one; a text of any length is
parsed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import text_blocks

PIECE = 512
TRAIN_ROWS, TRAIN_CHARS = 64, 40_000
MAX_ALPHABET = 250
#: Bytes up to which every state has a row of all symbols.
DENSE_BYTES = 64 << 20
_models: dict[int, "Automata"] = {}


def fold(text: str) -> str:
    """Lower-case letters; every run of other characters is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def sample_labelled(docs: DataFrame, text_col: str, lang_col: str, id_col: str, train_rows: int, train_chars: int) -> dict[str, str]:
    """Bounded training text per language; ranks move hashes only."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    name = [F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.xxhash64(text_col).alias("print")]
    order = ["key", "print"]
    # rows of one id and text are one candidate; the first ranking within each slice of the keys holds the slices' winners, whatever share of the rows one language has
    part = labelled.select(*name).distinct().withColumn("slice", F.pmod(F.hash("key", "print"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(f"r <= {train_rows}")
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"r <= {train_rows}").select("lang", *order)
    rows = (
        labelled.select(*name, F.substring(text_col, 1, train_chars).alias("text"))
        .join(F.broadcast(top), ["lang", *order], "left_semi")  # train_rows names a language
        .groupBy("lang", *order)
        .agg(F.min("text").alias("text"))  # one row a name: train_rows texts a language
        .collect()
    )
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.key, r.print)):
        have = texts.get(r.lang, "")
        if len(have) < train_chars:
            texts[r.lang] = (have + " " + fold(r.text)).strip()[:train_chars]
    return {k: v for k, v in sorted(texts.items()) if v}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, a mapping from symbols for each state; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automata:
    """All languages' automata in one set of tables; state 0 is dead and stands for 'no phrase is open'.

    Most states have one way out. Where rows of all symbols for every state would take
    more than ``dense_bytes``, such a way is kept as a pair of symbol and target, and only
    states that branch have a row.
    """

    def __init__(self, texts: dict[str, str], dense_bytes: int = DENSE_BYTES):
        self.langs = list(texts)
        counts: dict[str, int] = {}
        for t in texts.values():
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        letters = sorted((c for c in counts if c != " "), key=lambda c: (-counts[c], c))[:MAX_ALPHABET]
        code = {" ": 1} | {c: k + 2 for k, c in enumerate(letters)}
        self.width = width = len(code) + 1  # symbol 0 is any letter that was not learned
        symbol, target, rows, row_of, roots, base, n_rows = [[0]], [[0]], [np.zeros((1, width), np.int32)], [[0]], [], 1, 1
        automata = [suffix_automaton([code.get(c, 0) for c in t]) for t in texts.values()]
        self.dense = 4 * width * sum(map(len, automata)) <= dense_bytes
        for automaton in automata:
            states = [{c: base + to for c, to in row.items() if c} for row in automaton]
            branching = [s for s, row in enumerate(states) if self.dense or len(row) > 1 or s == 0]
            table = np.zeros((len(branching), width), np.int32)
            place = np.zeros(len(states), np.int32)
            for k, s in enumerate(branching):
                place[s] = n_rows + k
                table[k, list(states[s])] = list(states[s].values())
            one = [next(iter(row.items())) if len(row) == 1 and not place[s] else (0, 0) for s, row in enumerate(states)]
            symbol.append([c for c, _ in one])
            target.append([to for _, to in one])
            rows.append(table)
            row_of.append(place)
            roots.append(table[0])
            base, n_rows = base + len(states), n_rows + len(branching)
        self.symbol_of, self.target = np.concatenate(symbol).astype(np.uint8), np.concatenate(target).astype(np.int32)
        self.row_of, self.rows = np.concatenate(row_of).astype(np.int32), np.concatenate(rows)
        self.root = np.stack(roots)
        self.bits = np.array([np.log2(max(len(t), 2)) for t in texts.values()])
        self.symbol = np.ones(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                self.symbol[cp] = code.get(low[0], 0)
        self.letter = np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol, 0 where there is no way on."""
        if self.dense:
            return self.rows.ravel()[state * self.width + symbols]
        row = self.row_of[state]
        return np.where(row > 0, self.rows[row, symbols], np.where(self.symbol_of[state] == symbols, self.target[state], 0))

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases [language, piece] of the pieces symbols[bounds[i]:bounds[i+1]]."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], bounds[:-1][order]
        longest = int(size[0]) if len(size) else 0
        alive = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
        state = np.zeros((len(self.langs), len(size)), np.int32)
        count = np.zeros(state.shape, np.int32)
        for t in range(longest):
            k = alive[t]
            s = symbols[begin[:k] + t]
            to = self.step(state[:, :k], s)
            cut = to == 0
            count[:, :k] += cut
            state[:, :k] = np.where(cut, self.root[:, s], to)
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text of a block."""
        n = len(offs) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = starts[offs]
        if len(points) != starts[-1]:  # text that is not valid UTF-8: decode one by one
            each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:])]
            points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        letter = self.letter[points]
        seen = np.concatenate([[0], np.cumsum(letter)])
        has = seen[bounds[1:]] > seen[bounds[:-1]]
        sym = self.symbol[points]
        keep = np.ones(len(sym), bool)  # of a run of blanks, within one text, the first stays
        keep[1:] = ~((sym[1:] == 1) & (sym[:-1] == 1))
        keep[bounds[:-1][bounds[:-1] < len(sym)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[bounds]
        sym = sym[keep].astype(np.int64)
        pieces = -(-np.diff(at) // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = np.append(at[:-1][owner] + rank * PIECE, len(sym))
        found = self.phrases(sym, cuts)
        cost = np.stack([np.bincount(owner, weights=row, minlength=n) for row in found]) * self.bits[:, None]
        best = np.argmin(cost, axis=0)
        first = cost[best, np.arange(n)]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            score = np.where(first + second > 0, second / np.maximum(first + second, 1e-9), 0.0)
        else:
            score = np.ones(n)
        langs = np.array(self.langs, object)[best]
        return list(np.where(has, langs, "und")), np.where(has, score, 0.0)


def _automata(texts: dict[str, str]) -> Automata:
    key = hash(tuple(texts.items()))
    if key not in _models:
        _models.clear()
        _models[key] = Automata(texts)
    return _models[key]


def _predict(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    texts = shared.value
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        names = [x for k, x in enumerate(batch.schema.names) if k != at]
        for i, j, data, offs in text_blocks(batch.column(at), 4 << 20):
            langs, score = _automata(texts).predict(data, offs) if texts else (["und"] * (j - i), np.zeros(j - i))
            cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])


def predict_language(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS
) -> DataFrame:
    """Each document's id with ``lang_pred`` and ``score``; learned from ``labelled`` only, predicted from the text only."""
    texts = sample_labelled(labelled, text_col, lang_col, id_col, train_rows, train_chars)
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most train_chars symbols a language
    narrow = docs.select(id_col, text_col)
    schema = f"`{id_col}` {dict(narrow.dtypes)[id_col]}, lang_pred string, score double"
    return narrow.mapInArrow(lambda batches: _predict(batches, shared, text_col), schema)
