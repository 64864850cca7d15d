"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page as article or furniture.

A block's input is the sum of vectors of its tag path (each element's tag and the words of its class, id and role, and each pair of nested
tags; an element's sum is its parent's and what it adds), the mean of hashed-word vectors of its whole text, and a few measures. The network reads the blocks of the
whole page in both directions, so each label rests on document-wide context. It is written in numpy and trained here by
backpropagation through time on PAGES generated pages whose labels are known by construction; rows that training has not met are
zero vectors, so unknown names and words say nothing. Training depends on nothing but the parameters, and takes place once in a driver.

Defined results: a null or empty page, or one without article blocks, gives an empty text with n_chars 0. Repeated rows get equal
results; null ids and urls pass through; empty tables give empty ones. Only page_id, url and html are read. Pages are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import U, Words, pieces
from graphloom.llm.html_blocks import PATHS, Block, blocks
from graphloom.llm.page_templates import sample_page

#: Generated pages for training, passes over them, and pages in a step.
PAGES, EPOCHS, BATCH, STEP_SIZE = 960, 6, 48, 0.02
#: A mean of word vectors counts so many words more than there are, all zero, so one word weighs little; in training it is left out for this share of blocks.
DAMPED, LEFT_OUT = 3, 0.3
WORDS, SIZE, MEASURES, HIDDEN = 4096, 16, 7, 16
#: Blocks (padding included) that the network works on at a time; a page with more is worked on alone.
CELLS = 1 << 16


def path_rows(block: Block) -> list[int]:
    """Rows of the path table: names by element, nested pairs of tags, and the tag of the block itself."""
    out, node = list(block.leaf), block.node
    while node is not None:
        out += node.rows
        node = node.parent
    return out


def measures(block: Block) -> list[float]:
    text = block.text
    n = len(text)
    return [math.log1p(n) / 8, min(1.0, block.linked / n), min(5, sum(map(text.count, ".!?。"))) / 5, float("©" in text), float(text[-1] in ".!?:\"”。"), float(block.linked > 0), 1.0]


class Labeller:
    """Weights and the forward and backward passes."""

    def __init__(self) -> None:
        rng, d, h = np.random.default_rng(11), 2 * SIZE + MEASURES, HIDDEN
        self.w = {"path": np.zeros((PATHS, SIZE)), "word": np.zeros((WORDS, SIZE))}
        for k in "fb":
            self.w[f"x{k}"] = rng.normal(0, d**-0.5, (d, 4 * h))
            self.w[f"h{k}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.w[f"c{k}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w["o"] = rng.normal(0, 0.3, 2 * h)
        self.w["ox"] = np.zeros(d)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self._cache: dict[tuple, np.ndarray] = {}

    def _sum(self, rows: tuple[int, ...]) -> np.ndarray:
        found = self._cache.get(rows)
        if found is None:
            if len(self._cache) > 20_000:
                self._cache.clear()
            found = self._cache[rows] = self.w["path"][list(rows)].sum(axis=0)
        return found

    def path_vector(self, block: Block) -> np.ndarray:
        todo, node = [], block.node
        while node is not None and node.vector is None:
            todo.append(node)
            node = node.parent
        vector = node.vector if node is not None else self._sum(())
        for x in reversed(todo):
            vector = x.vector = vector + self._sum(x.rows) if x.rows else vector
        return vector + self._sum(block.leaf) if block.leaf else vector

    def _direction(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time x pages x HIDDEN); beyond a page's end the state stays at zero."""
        h, (steps, n, _) = HIDDEN, x.shape
        z_in = x @ self.w[f"x{k}"] + self.w[f"c{k}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((steps, n, h), np.float32), []
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + state @ self.w[f"h{k}"]
            gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            was = cell
            cell = (f * cell + i * g) * mask[t][:, None]
            bent = np.tanh(cell)
            if keep:
                tape.append((t, state, was, i, f, o, g, bent))
            out[t] = state = o * bent * mask[t][:, None]
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tape_f = self._direction(x, mask, "f", keep)
        b, tape_b = self._direction(x, mask, "b", keep)
        h = HIDDEN
        logit = f @ self.w["o"][:h] + b @ self.w["o"][h:] + x @ self.w["ox"]
        return logit, f, b, tape_f, tape_b

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the dense weights, and that of the input."""
        h = HIDDEN
        logit, f, b, tape_f, tape_b = self.forward(x, mask, keep=True)
        p = 0.5 + 0.5 * np.tanh(0.5 * logit)
        total = mask.sum()
        loss = float(-((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) * mask).sum() / total)
        d = ((p - y) * mask / total).astype(np.float32)
        grad = {"o": np.concatenate([np.einsum("tn,tnh->h", d, f), np.einsum("tn,tnh->h", d, b)]), "ox": np.einsum("tn,tnd->d", d, x)}
        dx = d[:, :, None] * self.w["ox"]
        for k, tape, part in (("f", tape_f, self.w["o"][:h]), ("b", tape_b, self.w["o"][h:])):
            dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            wh, gh = self.w[f"h{k}"], np.zeros_like(self.w[f"h{k}"])
            carry, dcell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, state, was, i, fg, o, g, bent in reversed(tape):
                m = mask[t][:, None]
                ds = (d[t][:, None] * part + carry) * m
                dc = (dcell + ds * o * (1 - bent * bent)) * m
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * was * fg * (1 - fg), ds * bent * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gh += state.T @ dz[t]
                carry, dcell = dz[t] @ wh.T, dc * fg
            grad |= {f"x{k}": np.einsum("tnd,tnz->dz", x, dz, optimize=True), f"h{k}": gh, f"c{k}": dz.sum(axis=(0, 1))}
            dx = dx + dz @ self.w[f"x{k}"].T
        return loss, grad, dx


def _word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, first): text i has the words first[i]:first[i+1]."""
    w = Words(pa.array(texts, pa.string()), lower=True)
    return (w.name % U(WORDS)).astype(np.int64), w.first


def _sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over rows[first[i]:first[i + 1]]."""
    run = np.zeros((len(rows) + 1, table.shape[1]), np.float64)
    np.cumsum(table[rows], axis=0, out=run[1:])
    return (run[first[1:]] - run[first[:-1]]).astype(np.float32)


def _inputs(net: Labeller, page_blocks: list[list[Block]]) -> np.ndarray:
    """Input of every block, all pages one after the other."""
    flat = [b for page in page_blocks for b in page]
    rows, first = _word_rows([b.text for b in flat])
    words = _sums(net.w["word"], rows, first) / (np.diff(first) + DAMPED)[:, None]
    return np.concatenate([np.stack([net.path_vector(b) for b in flat]), words, np.array([measures(b) for b in flat], np.float32)], axis=1, dtype=np.float32)


def _padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(sizes)
    out, mask = np.zeros((steps, len(sizes), x.shape[1]), np.float32), np.zeros((steps, len(sizes)), np.float32)
    at = 0
    for j, n in enumerate(sizes):
        out[:n, j], mask[:n, j] = x[at : at + n], 1
        at += n
    return out, mask


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """A network fitted to generated pages with Adam; the same parameters give the same network."""
    rng, net = np.random.default_rng(seed), Labeller()
    data = []
    while len(data) < pages:
        html, labels = sample_page(rng)
        found = blocks(html)
        if len(found) == len(labels):
            paths = [path_rows(b) for b in found]
            path_first = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            data.append((np.concatenate(paths), path_first, *_word_rows([b.text for b in found]), np.array([measures(b) for b in found], np.float32), np.array(labels, np.float32)))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, last = 0, epochs * math.ceil(pages / BATCH)
    by_length = sorted(range(pages), key=lambda i: len(data[i][5]))
    groups = [by_length[a : a + BATCH] for a in range(0, pages, BATCH)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            step += 1
            batch = [data[i] for i in groups[g]]
            sizes = [len(d[5]) for d in batch]
            keep = (rng.random(sum(sizes)) >= LEFT_OUT)[:, None] / (np.concatenate([np.diff(d[3]) for d in batch]) + DAMPED)[:, None]
            x = np.concatenate(
                [np.concatenate([_sums(net.w["path"], d[0], d[1]) for d in batch]), np.concatenate([_sums(net.w["word"], d[2], d[3]) for d in batch]) * keep, np.concatenate([d[4] for d in batch])],
                axis=1,
                dtype=np.float32,
            )
            padded, mask = _padded(x, sizes)
            y, _ = _padded(np.concatenate([d[5] for d in batch])[:, None], sizes)
            _, grad, dx = net.gradient(padded, mask, y[:, :, 0])
            flat = np.concatenate([dx[:n, j] for j, n in enumerate(sizes)])
            grad["path"], grad["word"] = np.zeros_like(net.w["path"]), np.zeros_like(net.w["word"])
            np.add.at(grad["path"], np.concatenate([d[0] for d in batch]), np.repeat(flat[:, :SIZE], np.concatenate([np.diff(d[1]) for d in batch]), axis=0))
            np.add.at(grad["word"], np.concatenate([d[2] for d in batch]), np.repeat((flat[:, SIZE : 2 * SIZE] * keep).astype(np.float32), np.concatenate([np.diff(d[3]) for d in batch]), axis=0))
            rate = STEP_SIZE * (1 - (step - 1) / last) * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, g in grad.items():
                touched = (np.abs(g).sum(axis=1) > 0)[:, None] if k in ("path", "word") else 1
                first[k] += 0.1 * (g - first[k]) * touched
                second[k] += 0.01 * (g * g - second[k]) * touched
                net.w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-6) * touched).astype(np.float32)
    return net


def label(net: Labeller, page_blocks: list[list[Block]]) -> list[np.ndarray]:
    """For each page whether each of its blocks is article text."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(page_blocks)
    order = sorted((i for i, p in enumerate(page_blocks) if p), key=lambda i: len(page_blocks[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(page_blocks[order[to]]) <= CELLS:
            to += 1
        group = order[at:to]
        sizes = [len(page_blocks[i]) for i in group]
        padded, mask = _padded(_inputs(net, [page_blocks[i] for i in group]), sizes)
        logit = net.forward(padded, mask)[0]
        for j, i in enumerate(group):
            out[i] = logit[: sizes[j], j] > 0
        at = to
    return out


_trained: dict[tuple, Labeller] = {}


def labeller(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The trained network, made once in a process."""
    if (pages, epochs) not in _trained:
        _trained[pages, epochs] = train(pages, epochs)
    return _trained[pages, epochs]


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(page, labels, strict=True) if keep) for page, labels in zip(found, label(net, found), strict=True)]


def _run(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = weights.value
        for batch in batches:
            for part in pieces(batch, "html"):
                text = main_texts(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html). The weights (below 1 MB, a fixed size) are broadcast."""
    weights = pages.sparkSession.sparkContext.broadcast((net or labeller()).w)
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cols.mapInArrow(_run(weights), "page_id long, url string, text string, n_chars long")
