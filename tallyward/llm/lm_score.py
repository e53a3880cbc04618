"""Language-model scores of documents: a causal self-attention model in numpy over subword ids.

Every token (a word, or the end of its text) is cut into subword ids of a public vocabulary, the longest piece that fits
first: the ids are every byte and the pieces that most tokens begin with, 1,023 in all, and one for the end.  The model
attends to all subword ids of the tokens before: a place of its input is the sum of the embeddings of a token's ids.  A
text's probability is the product over its tokens of P(first id | ids before), which is the attention model's, by classes
of ids and then by members, and P(the token | its first id), for the ids behind the first, which comes from the counts of
all training tokens that begin with it, smoothed by one: what follows within a word is a matter of the word, which counts
know exactly and a model of this size does not.

Counting: a task sums its tokens and hands on (hash, count, subword); Spark sums these for all tasks.  Training: each
task runs Adam from the same weights over windows of its training documents; the weights are averaged by windows, and
the next round starts there, so scores depend (in their last digits) on how the table is dealt into tasks.  The windows
of a text follow each other and the rounds take them in turns, so every training token is learned from, just once.  Scoring: windows overlap by
``CONTEXT`` ids, each token is scored once, in the window in which it has most context, and windows are run in batches
under a causal mask.  Words with a count above a threshold, ``HEAD_WORDS`` at most, are sent to the tasks; the others
are looked up by a join.

Cases: a null or empty text has one token, its end; a text without words, too; very long texts are scored whole;
without training documents all counts are 0 and the model has its starting weights; rows that repeat an id are scored
each; a null id counts as not held out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import textkit
from tallyward.plans.lineage import written

HEAD_WORDS = 500_000
#: Subword ids: FAN classes of FAN ids each.
FAN = 32
IDS, WIDTH, WINDOW, CONTEXT = FAN * FAN, 16, 32, 8
END, START = IDS - 1, IDS
ROUNDS, BATCH, RATE = 2, 64, 1e-2
#: Share of the attention model in P(subword id | ids before); the rest is the ids' own frequency.
TRUST = 0.97
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)
_PIECE_BYTES = 8
#: Words of more bytes are cut into pieces one by one.
_LONG_WORD = 64


class Subwords:
    """The pieces of a vocabulary in lower case, of up to 8 bytes; every byte is a piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        found = {model.id_to_piece(k).replace("▁", "").lower().encode() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
        self.pieces = sorted({p for p in found if 1 < len(p) <= _PIECE_BYTES} | {bytes([b]) for b in range(256) if not 65 <= b <= 90})
        self.size = len(self.pieces)
        self.power = textkit._power_tables(_PIECE_BYTES)[0]

    def hashes(self, pieces: list[bytes]) -> np.ndarray:
        """Of pieces of one length, as a running sum over a text's bytes gives them."""
        n = len(pieces[0])
        return (textkit._LOWER_VALUES[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)] * self.power[:n]).sum(axis=1, dtype=np.uint64)


class _Lookup:
    """Values of hashes: a table without collisions for some hundred keys, a sorted list for more."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.values, self.factor = hashes[order], values[order], None
        if len(hashes) <= 1024:
            rng = np.random.default_rng(7)
            for tries in range(64):
                bits = 12 + tries // 8
                factor, shift = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1), np.uint64(64 - bits)
                slot = hashes * factor >> shift
                if len(np.unique(slot)) == len(slot):
                    self.factor, self.shift = factor, shift
                    self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
                    self.keys[slot], self.values[slot] = hashes, values
                    return

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value) of each."""
        at = hashes * self.factor >> self.shift if self.factor is not None else np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, self.values[at]


class Cutter:
    """Cuts words into some of the pieces, the longest that fits first; ``values`` gives each piece its number."""

    def __init__(self, pieces: Subwords, values: dict[bytes, int]):
        self.power, self.tables = pieces.power, []
        for n in range(1, _PIECE_BYTES + 1):
            if own := sorted(p for p in values if len(p) == n):
                self.tables.append((n, _Lookup(pieces.hashes(own), np.array([values[p] for p in own], np.int32))))

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, bytes) of the longest piece at each place, that reaches no further than the word's end."""
        value, size, held, done = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64), 0
        for n, table in self.tables:
            for k in range(done, n):
                held += textkit._LOWER_VALUES[data[np.minimum(at + k, len(data) - 1)]] * self.power[k]
            done = n
            there, found = table.find(held)
            hit = np.flatnonzero(there & (at + n <= ends))
            value[hit], size[hit] = found[hit], n
        return value, size

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first piece of each word, how many more it has, those in order)."""
        first, size = self.longest(data, starts, ends)
        more, owner, order = [], [], []
        short = ends - starts <= _LONG_WORD
        rest, at, place = np.flatnonzero((starts + size < ends) & short), starts + size, 0
        while len(rest):
            value, size = self.longest(data, at[rest], ends[rest])
            more.append(value)
            owner.append(rest)
            order.append(np.full(len(rest), place))
            at[rest] += size
            rest, place = rest[at[rest] < ends[rest]], place + 1
        for k in np.flatnonzero((at < ends) & ~short).tolist():
            value, size = self.longest(data, np.arange(at[k], ends[k]), np.full(ends[k] - at[k], ends[k]))
            steps, here, size = [], 0, size.tolist()
            while here < len(size):
                steps.append(here)
                here += size[here]
            more.append(value[steps])
            owner.append(np.full(len(steps), k))
            order.append(np.arange(len(steps)))
        counts = np.zeros(len(starts), np.int64)
        if not more:
            return first, counts, np.zeros(0, np.int32)
        more, owner, order = map(np.concatenate, (more, owner, order))
        counts += np.bincount(owner, minlength=len(starts))
        return first, counts, more[np.lexsort((order, owner))]


_subwords: dict[str, Subwords] = {}
_cutters: dict[tuple, Cutter] = {}


def subwords(model_file: str) -> Subwords:
    if model_file not in _subwords:
        _subwords.clear()
        _subwords[model_file] = Subwords(model_file)
    return _subwords[model_file]


def cutter(model_file: str, chosen: tuple[int, ...] | None = None) -> Cutter:
    """For all pieces, numbered as they are; or for some, numbered by their place among those."""
    key = (model_file, chosen)
    if key not in _cutters:
        if len(_cutters) > 2:
            _cutters.clear()
        pieces = subwords(model_file)
        _cutters[key] = Cutter(pieces, {pieces.pieces[p]: k for k, p in enumerate(range(pieces.size) if chosen is None else chosen)})
    return _cutters[key]


class Slice:
    """The words of some texts as subword ids, once for each different word; of all words, or of those that are needed."""

    def __init__(self, cut: Cutter, words: textkit.Words, needed: np.ndarray | None = None):
        self.words = words
        places = np.arange(len(words.hashes)) if needed is None else np.flatnonzero(needed)
        self.hashes, first, own = np.unique(words.hashes[places], return_index=True, return_inverse=True)
        self.word = own
        if needed is not None:
            self.word = np.zeros(len(needed), np.int64)
            self.word[places] = own
        first = places[first]
        self.lead, self.more, self.rest = cut.cut(words.data, words.starts[first], words.ends[first])
        self.begin = np.cumsum(self.more) - self.more

    def rest_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids behind the first, place in ``word`` of each) of words."""
        n = self.more[word]
        owner = np.repeat(np.arange(len(word)), n)
        return self.rest[self.begin[word[owner]] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)], owner


#: Scores before an exponential are held within these bounds; no weight is lost to overflow then.
_BOUND = 60.0


def _exponentials(scores: np.ndarray) -> None:
    np.clip(scores, -_BOUND, _BOUND, out=scores)
    np.exp(scores, out=scores)


class Attention:
    """One layer of causal self-attention with a residual path, and its gradients.

    A place of the input is the sum of the embeddings of all subword ids of a token, the first by one table and the
    others by another; the output is a distribution over ids by classes, then by members of the class.
    """

    NAMES = ("E", "R", "P", "Wq", "Wk", "Wv", "Wo", "U", "b", "V", "d")

    def __init__(self, frequency: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        classes = frequency.reshape(FAN, FAN)
        self.w = {"E": small(IDS + 1, WIDTH), "R": np.zeros((IDS, WIDTH), np.float32), "P": small(WINDOW, WIDTH), **{n: small(WIDTH, WIDTH) for n in ("Wq", "Wk", "Wv", "Wo")}}
        self.w |= {"U": np.zeros((WIDTH, FAN), np.float32), "b": np.log(classes.sum(axis=1)).astype(np.float32), "V": np.zeros((FAN, WIDTH, FAN), np.float32), "d": np.log(classes / classes.sum(axis=1, keepdims=True)).astype(np.float32)}
        self.frequency = frequency
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def embedded(self, lead: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows for tokens with first ids ``lead`` and further ids ``rest`` of the tokens ``owner`` (rising)."""
        x = self.w["E"][lead]
        if len(rest):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            x[owner[first]] += np.add.reduceat(self.w["R"][rest], first)
        return x

    def states(self, x: np.ndarray) -> dict:
        """x: (windows, places, WIDTH), embedded tokens."""
        w, n = self.w, x.shape[1]
        x = x + w["P"][:n]
        q, k, v = x @ w["Wq"], x @ w["Wk"], x @ w["Wv"]
        a = (q * WIDTH**-0.5) @ k.transpose(0, 2, 1)
        _exponentials(a)
        a *= self.mask[:n, :n]
        a /= (a @ np.ones(n, a.dtype))[..., None]
        z = a @ v
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "z": z, "h": x + z @ w["Wo"]}

    def _outputs(self, h: np.ndarray, wanted: np.ndarray) -> tuple:
        """Rows ordered by class: (order, bounds of the classes, states, class weights, member weights)."""
        kind = (wanted // FAN).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        h, kind = h[order], kind[order]
        bounds = np.searchsorted(kind, np.arange(FAN + 1))
        by_class = h @ self.w["U"]
        by_class += self.w["b"]
        member = np.empty((len(h), FAN), h.dtype)
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            np.matmul(h[bounds[c] : bounds[c + 1]], self.w["V"][c], out=member[bounds[c] : bounds[c + 1]])
        member += self.w["d"][kind]
        _exponentials(by_class)
        _exponentials(member)
        return order, bounds, h, by_class, member

    def log10_next(self, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of the wanted ids after states h (rows)."""
        order, _, _, by_class, member = self._outputs(h, wanted)
        row, own, ones = np.arange(len(order)), wanted[order], np.ones(FAN, member.dtype)
        p = (by_class[row, own // FAN] / (by_class @ ones)).astype(np.float64) * (member[row, own % FAN] / (member @ ones))
        out = np.empty(len(order))
        out[order] = np.log10(TRUST * p + (1 - TRUST) * self.frequency[own])
        return out

    def gradients(self, lead: np.ndarray, rest: np.ndarray, owner: np.ndarray, wanted: np.ndarray, real: np.ndarray) -> dict:
        """Of the mean loss over the real places of windows: lead, wanted, real are (windows, places); owner is flat."""
        w, flat = self.w, lambda t: t.reshape(-1, t.shape[-1])
        s = self.states(self.embedded(lead.ravel(), rest, owner).reshape(*lead.shape, WIDTH))
        places = np.flatnonzero(real)
        order, bounds, h, by_class, member = self._outputs(flat(s["h"])[places], wanted.ravel()[places])
        places, own, row = places[order], wanted.ravel()[places][order], np.arange(len(order))
        # Of the mean over all rows.
        share, ones = 1 / max(1, len(row)), np.ones(FAN, member.dtype)
        by_class *= (share / (by_class @ ones))[:, None]
        member *= (share / (member @ ones))[:, None]
        by_class[row, own // FAN] -= share
        member[row, own % FAN] -= share
        g = {"U": h.T @ by_class, "b": by_class.sum(axis=0), "V": np.zeros_like(w["V"]), "d": np.zeros_like(w["d"])}
        d = by_class @ w["U"].T
        there = np.flatnonzero(np.diff(bounds))
        if len(there):
            g["d"][there] = np.add.reduceat(member, bounds[there])
        for c in there.tolist():
            part = slice(bounds[c], bounds[c + 1])
            np.matmul(h[part].T, member[part], out=g["V"][c])
            d[part] += member[part] @ w["V"][c].T
        dh = np.zeros_like(flat(s["h"]))
        dh[places] = d
        dh = dh.reshape(s["h"].shape)
        g["Wo"] = flat(s["z"]).T @ flat(dh)
        dz = dh @ w["Wo"].T
        da = dz @ s["v"].transpose(0, 2, 1)
        dv = s["a"].transpose(0, 2, 1) @ dz
        da -= np.einsum("bij,bij->bi", da, s["a"])[..., None]
        da *= s["a"]
        da *= WIDTH**-0.5
        dq, dk = da @ s["k"], da.transpose(0, 2, 1) @ s["q"]
        dx = dh + dq @ w["Wq"].T + dk @ w["Wk"].T + dv @ w["Wv"].T
        for name, y in (("Wq", dq), ("Wk", dk), ("Wv", dv)):
            g[name] = flat(s["x"]).T @ flat(y)
        g["E"] = _summed_by(lead.ravel(), flat(dx), IDS + 1)
        g["R"] = _summed_by(rest, flat(dx)[owner], IDS)
        g["P"] = np.zeros_like(w["P"])
        g["P"][: lead.shape[1]] = dx.sum(axis=0)
        return g

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            size = self.w[n].size
            self.w[n] = vector[at : at + size].reshape(self.w[n].shape).astype(np.float32)
            at += size


def _summed_by(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their ids."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(ids):
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # sixteen bits are sorted by digits
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        out[ids[order][first]] = np.add.reduceat(rows[order], first)
    return out


class Adam:
    """Steps in place; all weights are parts of one vector."""

    def __init__(self, model: Attention):
        self.steps, self.at = 0, {}
        self.weights, begin = model.vector().astype(np.float32), 0
        for n in model.NAMES:
            size, shape = model.w[n].size, model.w[n].shape
            self.at[n] = slice(begin, begin + size)
            model.w[n] = self.weights[self.at[n]].reshape(shape)
            begin += size
        self.m, self.v, self.g, self.x = (np.zeros_like(self.weights) for _ in range(4))

    def step(self, gradients: dict) -> None:
        self.steps += 1
        g, x = self.g, self.x
        for n, part in gradients.items():
            g[self.at[n]] = part.ravel()
        self.m *= 0.9
        self.m += np.multiply(g, 0.1, out=x)
        self.v *= 0.99
        np.multiply(g, g, out=x)
        x *= 0.01
        self.v += x
        np.multiply(self.v, 1 / (1 - 0.99**self.steps), out=x)
        np.sqrt(x, out=x)
        x += 1e-8
        np.divide(self.m, x, out=x)
        x *= RATE / (1 - 0.9**self.steps)
        self.weights -= x


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    pieces, held, texts = cutter(model_file), [], 0

    def merged(parts: list) -> tuple:
        h, n, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, place = np.unique(h, return_index=True, return_inverse=True)
        return keys, np.bincount(place, n).astype(np.int64), lead[first]

    for batch in batches:
        texts += len(batch)
        for _, _, data, offsets in textkit.slices(batch.column(0)):
            w = textkit.words(data, offsets)
            keys, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            # The piece is sought for words only that the merged counts don't hold yet.
            lead = np.full(len(keys), -1, np.int32)
            new = np.ones(len(keys), bool)
            if held and len(held[0][0]):
                at = np.minimum(np.searchsorted(held[0][0], keys), len(held[0][0]) - 1)
                new = held[0][0][at] != keys
                lead[~new] = held[0][2][at[~new]]
            lead[new] = pieces.longest(data, w.starts[first[new]], w.ends[first[new]])[0]
            held.append((keys, n, lead))
            if len(held) in (1, 16):
                held = [merged(held)]
    if texts:
        held.append((np.array([END_HASH]), np.array([texts]), np.array([-1], np.int32)))
        keys, n, lead = merged(held)
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000]), pa.array(lead[k : k + 100_000].astype(np.int32))], ["hash", "n", "lead"])


def _windows(bounds: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first place) of the windows of a round: those of all rounds hold each place once."""
    size = np.diff(bounds)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    mine = (number + size[text]) % ROUNDS == turn
    return text[mine], (bounds[text] + number * WINDOW)[mine]


def _train(batches: Iterator[pa.RecordBatch], model_file: str, shared, turn: int) -> Iterator[pa.RecordBatch]:
    frequency, vector, chosen = shared.value
    model, cut = Attention(frequency), cutter(model_file, chosen)
    model.load(vector)
    adam, windows, held, waiting = Adam(model), 0, [], 0

    def step() -> None:
        lead, wanted, real = (np.concatenate([h[k] for h in held]) for k in range(3))
        sizes = np.cumsum([0, *(h[0].size for h in held)])
        adam.step(model.gradients(lead, np.concatenate([h[3] for h in held]), np.concatenate([h[4] + a for h, a in zip(held, sizes, strict=False)]), wanted, real))

    for batch in batches:
        for _, _, data, offsets in textkit.slices(batch.column(0)):
            w = textkit.words(data, offsets)
            bounds = w.bounds + np.arange(len(w.bounds))
            text, begin = _windows(bounds, turn)
            windows += len(begin)
            # The words of this turn's windows: what is wanted in them, and what stands before that.
            inside = np.zeros(bounds[-1] + WINDOW + 1, np.int8)
            inside[begin] += 1
            inside[np.minimum(begin + WINDOW, bounds[text + 1])] -= 1
            inside = np.cumsum(inside, dtype=np.int8) > 0
            place = np.arange(len(w.hashes)) + np.repeat(np.arange(len(bounds) - 1), np.diff(w.bounds))
            words = Slice(cut, w, inside[place] | inside[place + 1])
            for k in range(0, len(begin), BATCH):
                own = text[k : k + BATCH, None]
                at = begin[k : k + BATCH, None] + np.arange(WINDOW)
                end = bounds[own + 1]
                real = at < end
                word = at - own  # of the wanted id; the last place is the end of the text
                lead, wanted = np.full(at.shape, START), np.full(at.shape, END)
                inner = real & (at < end - 1)
                wanted[inner] = words.lead[words.word[word[inner]]]
                inner = real & (at > bounds[own])
                before = words.word[word[inner] - 1]
                lead[inner] = words.lead[before]
                rest, owner = words.rest_of(before)
                held.append((lead, wanted, real, rest, np.flatnonzero(inner)[owner]))
                waiting += len(at)
                if waiting >= BATCH:
                    step()
                    held, waiting = [], 0
    if held:
        step()
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([(model.vector().astype(np.float64) * windows).tolist()], pa.list_(pa.float64()))], ["windows", "weights"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows, weights = 0, None
    for batch in batches:
        for n, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = row.values.to_numpy()
            windows, weights = windows + n, row.copy() if weights is None else weights + row
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], ["windows", "weights"])


class Tables:
    """What scoring needs: frequent words with counts, sums by id, the chosen pieces and the attention model."""

    def __init__(self, hashes, counts, chosen, of_id, model):
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], np.log10(counts[order] + 1.0)
        self.chosen, self.of_id, self.model = chosen, of_id, model


def window_scores(model: Attention, x: np.ndarray, wanted: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 P(id | ids before) at each place: overlapping windows, each place scored once, in the window in which it has
    most context; x: embedded inputs of the places."""
    out, fresh = np.zeros(len(x)), WINDOW - CONTEXT
    size = np.diff(bounds)
    more = np.maximum(0, -(-(size - WINDOW) // fresh))
    text = np.repeat(np.arange(len(size)), more + 1)
    number = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    begin = bounds[text] + number * fresh
    for k in range(0, len(begin), 256):
        at = begin[k : k + 256, None] + np.arange(WINDOW)
        end = bounds[text[k : k + 256] + 1][:, None]
        scored = (at < end) & ((number[k : k + 256, None] == 0) | (np.arange(WINDOW) >= CONTEXT))
        h = model.states(x[np.minimum(at, len(x) - 1)])["h"][scored]
        place = at[scored]
        out[place] = model.log10_next(h, wanted[place])
    return out


def _score(batches: Iterator[pa.RecordBatch], model_file: str, shared) -> Iterator[pa.RecordBatch]:
    t, task, seen = shared.value, TaskContext.get().partitionId(), 0
    cut = cutter(model_file, t.chosen)
    for batch in batches:
        for a, b, data, offsets in textkit.slices(batch.column(2)):
            w, n = textkit.words(data, offsets), b - a
            words = Slice(cut, w)
            at = np.minimum(np.searchsorted(t.hashes, words.hashes), max(0, len(t.hashes) - 1))
            known = t.hashes[at] == words.hashes if len(t.hashes) else np.zeros(len(words.hashes), bool)
            logs = np.where(known, t.logs[at], 0.0) if len(t.hashes) else np.zeros(len(known))
            # A place for each token and one for the end of each text; its input is the token before.
            bounds, text = w.bounds + np.arange(n + 1), np.repeat(np.arange(n), np.diff(w.bounds))
            place = np.arange(len(text)) + text
            wanted = np.full(bounds[-1], END)
            wanted[place] = words.lead[words.word]
            x = np.empty((bounds[-1], WIDTH), np.float32)
            x[bounds[:-1]] = t.model.w["E"][START]
            every = np.arange(len(words.lead))
            x[place + 1] = t.model.embedded(words.lead, *words.rest_of(every))[words.word]
            scores = window_scores(t.model, x, wanted, bounds) - t.of_id[wanted]
            here = known[words.word]
            tails = np.split(textkit.signed(words.hashes[words.word[~here]]), np.searchsorted(np.flatnonzero(~here), w.bounds[1:-1]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(seen, seen + n) + (task << 40)), batch.column(0).slice(a, n), batch.column(1).slice(a, n),
                pa.array(np.diff(w.bounds) + 1), pa.array(np.bincount(text, here, n).astype(np.int64)),
                pa.array(np.bincount(text, logs[words.word], n).astype(np.float64)), pa.array(np.add.reduceat(scores, bounds[:-1])), pa.array(tails, pa.list_(pa.int64())),
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "path", "tail"])
            seen += n


def scores(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    training = source.filter("not held_out").select("text")
    vocabulary = written(training.mapInArrow(textkit.ending(partial(_count, model_file=model_file)), "hash long, n long, lead int").groupBy("hash").agg(F.sum("n").alias("n"), F.first("lead").alias("lead")))

    # Sums by leading piece: as many rows as pieces at most.
    leads = vocabulary.groupBy("lead").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, kinds = sum(r["n"] for r in leads), sum(r["v"] for r in leads)
    # The ids: every byte, and the pieces that most tokens begin with.
    pieces = subwords(model_file)
    usage = {r["lead"]: r["n"] for r in leads}
    single = {k for k, p in enumerate(pieces.pieces) if len(p) == 1}
    common = sorted((k for k in usage if k >= 0 and k not in single), key=lambda k: (-usage[k], k))[: IDS - 1 - len(single)]
    chosen = tuple(sorted(single | set(common), key=lambda k: (-usage.get(k, 0), k)))
    # A token begins with the longest chosen piece that the longest one begins with.
    cut, data = cutter(model_file, chosen), np.frombuffer(b"".join(pieces.pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces.pieces])
    of_piece = cut.longest(data, np.concatenate([[0], ends[:-1]]), ends)[0]
    n, v = np.zeros(IDS), np.zeros(IDS)
    for r in leads:
        k = END if r["lead"] < 0 else of_piece[r["lead"]]
        n[k] += r["n"]
        v[k] += r["v"]
    frequency = (n + 0.05) / (n.sum() + 0.05 * IDS)

    model = Attention(frequency)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((frequency, model.vector(), chosen))
        own = training.mapInArrow(textkit.ending(partial(_train, model_file=model_file, shared=shared, turn=turn)), "windows long, weights array<double>")
        # One vector comes back, summed over the tasks in two steps.
        some = own.repartition(min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_summed, "windows long, weights array<double>")
        for r in some.coalesce(1).mapInArrow(_summed, "windows long, weights array<double>").collect():
            model.load(np.array(r["weights"]) / r["windows"])

    # The least count at which no more than head_words words are left.
    by_count = sorted(((r["n"], r["v"]) for r in vocabulary.groupBy("n").agg(F.count("*").alias("v")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for c, words in by_count:
        if held + words > head_words:
            break
        least, held = c, held + words
    head = vocabulary.filter((F.col("n") >= least) & (F.col("lead") >= 0)).toArrow()
    hashes = head["hash"].to_numpy().view(np.uint64)
    tables = Tables(hashes, head["n"].to_numpy(), chosen, np.log10(n + v + 1), model)
    shared = spark.sparkContext.broadcast(tables)

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = written(source.mapInArrow(textkit.ending(partial(_score, model_file=model_file, shared=shared)), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, path double, tail array<long>"))
    tail = rows.select("row", F.explode("tail").alias("hash")).join(vocabulary.filter(F.col("n") < least).select("hash", "n"), "hash")
    found = tail.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs2"))
    end_count = float(n[END])
    joined = rows.drop("tail").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("logs2", F.lit(0.0)) + float(np.log10(end_count + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(end_count > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + kinds + 1.0))).alias("base_score"), (logs + F.col("path")).alias("score"),
    )
