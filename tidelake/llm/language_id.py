"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

Two recurrent layers, one from each side, read a window of bytes; at every position their states together give the
language's log-probabilities, and a document's probabilities are the softmax of the mean over all its positions. The
gates are piecewise linear (clipped lines in place of sigmoid and tanh), which trains as well here and costs a tenth.
Training is backpropagation through time with Adam on windows of labelled texts; prediction runs over every byte of
every text, cut into windows whose states start from zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import map_texts

WINDOW = 96


class Gru:
    """One direction: z, r = gates; h' = (1 - z) h + z clip(c)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32),
            "c": rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32),
        }
        self.p["x"][:, : 2 * hidden] += 0.5

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """data: (steps, batch) bytes. States (steps, batch, hidden) and, if asked for, what the way back needs."""
        n, h = self.h, np.zeros((data.shape[1], self.h), np.float32)
        x, u, c = self.p["x"], self.p["u"], self.p["c"]
        states, tape = np.empty((*data.shape, n), np.float32), []
        for t in range(len(data)):
            a = x[data[t]]
            pre = a[:, : 2 * n] + h @ u
            gates = np.clip(pre, 0, 1)
            r = gates[:, n:]
            cand_pre = a[:, 2 * n :] + (r * h) @ c
            cand = np.clip(cand_pre, -1, 1)
            new = h + gates[:, :n] * (cand - h)
            if keep:
                tape.append((h, pre, gates, cand_pre, cand))
            h = new
            states[t] = h
        return states, tape

    def backward(self, data: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        n, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(grad[0])
        for t in range(len(data) - 1, -1, -1):
            h, pre, gates, cand_pre, cand = tape[t]
            z, r = gates[:, :n], gates[:, n:]
            dh = dh + grad[t]
            dz = dh * (cand - h)
            dc = dh * z * ((cand_pre > -1) & (cand_pre < 1))
            drh = dc @ self.p["c"].T
            dgates = np.hstack([dz, drh * h]) * ((pre > 0) & (pre < 1))
            g["c"] += (r * h).T @ dc
            g["u"] += h.T @ dgates
            np.add.at(g["x"], data[t], np.hstack([dgates, dc]))
            dh = dh * (1 - z) + drh * r + dgates @ self.p["u"].T
        return g


class LanguageModel:
    """``labels`` in sorted order; a label without training text can't be predicted."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Gru(hidden, rng), Gru(hidden, rng)
        self.out = rng.normal(0, 0.3, (2 * hidden + 1, len(labels))).astype(np.float32)

    def _position_logs(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        n = self.ahead.h
        logits = ahead @ self.out[:n] + back @ self.out[n : 2 * n] + self.out[-1]
        logits -= logits.max(-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def fit(self, windows: np.ndarray, targets: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.02):
        """windows: (n, WINDOW) bytes; targets: (n,) label numbers. Cross entropy at every position."""
        rng, m, v, t = np.random.default_rng(11), {}, {}, 0
        n = self.ahead.h
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                data, y = windows[rows].T, targets[rows]
                ahead, tape_a = self.ahead.forward(data, True)
                back, tape_b = self.back.forward(data[::-1], True)
                both = np.concatenate([ahead, back[::-1]], 2)
                d = np.exp(self._position_logs(ahead, back[::-1]))
                d[:, np.arange(len(rows)), y] -= 1
                d /= d.shape[0] * d.shape[1]
                flat = both.reshape(-1, 2 * n)
                grads = {"out": np.vstack([flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))[None]])}
                dboth = d @ self.out[:-1].T
                grads |= {f"a{k}": g for k, g in self.ahead.backward(data, tape_a, dboth[:, :, :n]).items()}
                grads |= {f"b{k}": g for k, g in self.back.backward(data[::-1], tape_b, dboth[::-1, :, n:]).items()}
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    change = step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    if k == "out":
                        self.out -= change.astype(np.float32)
                    else:
                        (self.ahead if k[0] == "a" else self.back).p[k[1:]] -= change.astype(np.float32)
        return self

    def document_logs(self, texts: list[bytes]) -> np.ndarray:
        """(n, labels): the sum of the log-probabilities of all positions of each whole text, divided by its length."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n_windows = -(-sizes // WINDOW)
        total = np.zeros((len(texts), len(self.labels)), np.float64)
        ends = np.cumsum(n_windows)
        data = np.zeros(int(ends[-1]) * WINDOW if len(ends) else 0, np.uint8)
        for t, end, k in zip(texts, ends.tolist(), n_windows.tolist(), strict=True):
            start = (end - k) * WINDOW
            data[start : start + len(t)] = np.frombuffer(t, np.uint8)
        windows = data.reshape(-1, WINDOW)
        doc = np.repeat(np.arange(len(texts)), n_windows)
        left = sizes[doc] - (np.arange(len(doc)) - (ends - n_windows)[doc]) * WINDOW
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096].T
            inside = np.arange(WINDOW)[:, None] < left[at : at + 4096][None, :]
            ahead, _ = self.ahead.forward(part)
            back, _ = self.back.forward(part[::-1])
            logs = self._position_logs(ahead, back[::-1])
            sums = np.einsum("tbl,tb->bl", logs, inside.astype(np.float32))
            np.add.at(total, doc[at : at + 4096], sums)
        return total / np.maximum(sizes, 1)[:, None]


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter; other word characters, such as ² or ½, are not."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def spread_windows(text: bytes, most: int = 40) -> list[bytes]:
    """At most ``most`` windows, evenly spread over the whole text."""
    starts = range(0, len(text), WINDOW)
    picked = starts if len(starts) <= most else [starts[int(i)] for i in np.linspace(0, len(starts) - 1, most)]
    return [text[a : a + WINDOW].ljust(WINDOW, b" ") for a in picked]


def train_on(windows: list[bytes], langs: list[str], per_label: int) -> LanguageModel:
    """Fit on at most ``per_label`` of the windows of each label."""
    rng, labels = np.random.default_rng(5), sorted(set(langs))
    by = {label: [w for w, x in zip(windows, langs, strict=True) if x == label] for label in labels}
    picked = [(by[x][i], k) for k, x in enumerate(labels) for i in rng.permutation(len(by[x]))[:per_label]]
    data = np.frombuffer(b"".join(w for w, _ in picked), np.uint8).reshape(-1, WINDOW)
    return LanguageModel(labels).fit(data, np.array([k for _, k in picked]))


def fit(
    train: DataFrame,
    max_docs: int = 400,
    per_label: int = 2500,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on windows of at most ``max_docs`` texts of each language, those with the smallest hashes of their ids.

    Languages are few by nature. Rows without language, and null or empty texts, teach nothing; a table without any
    language gives a model that only knows ``und``.
    """
    known = train.where(F.col(lang_col).isNotNull())
    picked = None
    for (lang,) in known.select(lang_col).distinct().collect():
        mine = known.where(F.col(lang_col) == lang).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
        picked = mine if picked is None else picked.union(mine)
    if picked is None:
        return LanguageModel(["und"])
    # max_docs ids for each language, so the picked ids may be sent to every task
    rows = known.select(F.col(lang_col).alias("lang"), id_col, text_col).join(F.broadcast(picked), id_col, "left_semi")

    def make():
        return lambda langs, texts: {"lang": langs, "windows": [spread_windows(t) for t in texts]}

    found = map_texts(rows, "lang", text_col, make, "lang string, windows array<binary>").collect()
    windows = [bytes(w) for r in found for w in r.windows]
    if not windows:
        return LanguageModel(["und"])
    return train_on(windows, [r.lang for r in found for _ in r.windows], per_label)


def predicted(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text; ``und`` and score 0 for a null text or one without a letter.

    Very long texts count whole; of languages that tie, the first in sorted order is taken; rows that repeat an id each
    have their own row; other columns, whatever their names, are not read.
    """

    def rows():
        def of(ids, texts):
            langs, scores = [], []
            for at in range(0, len(texts), 100):
                part = texts[at : at + 100]
                logs = model.document_logs(part)
                p = np.exp(logs - logs.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for t, q in zip(part, p, strict=True):
                    known = has_letter(t)
                    langs.append(model.labels[int(q.argmax())] if known else "und")
                    scores.append(float(q.max()) if known else 0.0)
            return {"id": ids, "lang_pred": langs, "score": scores}

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, rows, f"id {kind}, lang_pred string, score double").withColumnRenamed(
        "id", id_col
    )
