"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text are read in segments of SEGMENT bytes, forwards and backwards; at every byte the two states give a
distribution over the languages, and the mean of these over all bytes of the text that are no ASCII spaces, digits or signs is the
document's. The network is trained here, in numpy, by backpropagation through time with Adam, on at most SAMPLE segments of the documents whose
fold (crc32 of doc_id, modulo 5) is not HELD_OUT and whose language is known. Every segment of every such text may be drawn, wherever it stands; in a larger table each language has its own share of them, FEW at least. Which
segments these are follows from hashes, so training is repeatable.

Defined results: a text that is null or has no letter is ``und`` with score 0. With no labelled document at all everything is ``und``; with one language
everything with a letter is that one. Ties go to the language that sorts first. Texts are read whole. Repeated rows
get equal results; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled
from graphloom.llm.arrays import U, mix, pieces
from graphloom.session import materialise, release

FOLDS, HELD_OUT = 5, 0
#: The most labelled segments that the network learns from.
SAMPLE = 16_000
#: Segments of a rare language in the sample, if it has them.
FEW = 400
HIDDEN, SEGMENT, LANES = 12, 64, 2048
STEPS, BATCH, STEP_SIZE = 160, 128, 0.03
#: Bytes that say nothing about the language: they are read, but not pooled.
_MUTE = np.zeros(256, dtype=bool)
_MUTE[:65] = True
_MUTE[91:97] = True
_MUTE[123:128] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """A straight line between 0 and 1, as in hard gates."""
    np.multiply(x, 0.25, out=x)
    np.add(x, 0.5, out=x)
    return np.clip(x, 0, 1, out=x)


@dataclass
class Network:
    """Weights: per direction inputs by byte (256 x 3H, for update, reset and candidate) and recurrent ones; then the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str]) -> Network:
        rng, h = np.random.default_rng(3), HIDDEN
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            w[f"g{d}"] = rng.normal(0, 0.3, (h, 2 * h))
            w[f"c{d}"] = rng.normal(0, 0.3, (h, h))
        w["o"] = rng.normal(0, 0.3, (2 * h + 1, len(languages)))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, seq: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """State after each byte of ``seq`` (time x lanes) in direction d, and what backpropagation needs."""
        h, n = HIDDEN, seq.shape[1]
        out, tape = np.empty((len(seq), n, h), dtype=np.float32), []
        state = np.zeros((n, h), dtype=np.float32)
        for t in range(len(seq)) if d == "f" else reversed(range(len(seq))):
            x = self.weights[f"x{d}"][seq[t]]
            gates = _sigmoid(x[:, : 2 * h] + state @ self.weights[f"g{d}"])
            u, r = gates[:, :h], gates[:, h:]
            rs = r * state
            c = np.tanh(x[:, 2 * h :] + rs @ self.weights[f"c{d}"])
            new = state + u * (c - state)
            if keep:
                tape.append((t, state, gates, rs, c))
            out[t] = state = new
        return out, tape

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """Distribution at each byte (time x lanes x languages)."""
        f, _ = self.states(seq, "f")
        b, _ = self.states(seq, "b")
        h = HIDDEN
        z = f @ self.weights["o"][:h] + b @ self.weights["o"][h : 2 * h] + self.weights["o"][2 * h]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=2, keepdims=True)

    def gradient(self, seq: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean cross-entropy over weighted bytes) and its gradient, through time in both directions."""
        h, o = HIDDEN, self.weights["o"]
        f, tape_f = self.states(seq, "f", keep=True)
        b, tape_b = self.states(seq, "b", keep=True)
        both = np.concatenate([f, b, np.ones((*f.shape[:2], 1), np.float32)], axis=2)
        z = both @ o
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        at = np.arange(seq.shape[1])
        loss = float(-(np.log(np.maximum(p[:, at, target], 1e-9)) * weight).sum())
        dz = p
        dz[:, at, target] -= 1
        dz *= weight[:, :, None]
        grad = {"o": np.einsum("tbi,tbk->ik", both, dz, optimize=True)}
        dh = dz @ o[: 2 * h].T
        for d, tape, part in (("f", tape_f, dh[:, :, :h]), ("b", tape_b, dh[:, :, h:])):
            gx, gg, gc = (np.zeros_like(self.weights[f"{k}{d}"]) for k in "xgc")
            wg, wc = self.weights[f"g{d}"], self.weights[f"c{d}"]
            carry = np.zeros((seq.shape[1], h), dtype=np.float32)
            for t, state, gates, rs, c in reversed(tape):
                g = part[t] + carry
                u, r = gates[:, :h], gates[:, h:]
                dc = g * u * (1 - c * c)
                du = g * (c - state)
                drs = dc @ wc.T
                da = np.concatenate([du, drs * state], axis=1) * (0.25 * ((gates > 0) & (gates < 1)))
                carry = g * (1 - u) + drs * r + da @ wg.T
                gg += state.T @ da
                gc += rs.T @ dc
                np.add.at(gx, seq[t], np.concatenate([da, dc], axis=1))
            grad |= {f"x{d}": gx, f"g{d}": gg, f"c{d}": gc}
        return loss, grad


def train(segments: list[bytes], labels: list[str], steps: int = STEPS) -> Network:
    """A network for the languages in ``labels``, from segments of SEGMENT bytes or fewer; batches draw the languages evenly."""
    net = Network.fresh(sorted(set(labels)))
    if len(net.languages) < 2 or not segments:
        return net
    data = np.zeros((len(segments), SEGMENT), dtype=np.uint8)
    for i, s in enumerate(segments):
        data[i, : len(s)] = np.frombuffer(s[:SEGMENT], dtype=np.uint8)
    y = np.searchsorted(net.languages, labels)
    by = [np.flatnonzero(y == k) for k in range(len(net.languages))]
    rng = np.random.default_rng(5)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, BATCH // len(by) + 1) for rows in by])
        seq = np.ascontiguousarray(data[pick].T)
        weight = (~_MUTE[seq]).astype(np.float32)
        weight /= max(weight.sum(), 1)
        _, grad = net.gradient(seq, y[pick], weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = STEP_SIZE * min(1, 4 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, g in grad.items():
            g = g * min(1, 1 / max(norm, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    return net


def predict(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean distribution over the pooled bytes of each text (zeros where none is pooled)."""
    n, k = len(texts), len(net.languages)
    total, count = np.zeros((n, k)), np.zeros(n)
    raw = [(t.as_buffer() if t.is_valid else b"") for t in texts]
    lanes: list[tuple[int, np.ndarray]] = []
    for i, t in enumerate(raw):
        data = np.frombuffer(t, dtype=np.uint8)
        lanes += [(i, data[a : a + SEGMENT]) for a in range(0, len(data), SEGMENT)]
    for a in range(0, len(lanes), LANES):
        part = lanes[a : a + LANES]
        seq = np.zeros((len(part), SEGMENT), dtype=np.uint8)
        for j, (_, d) in enumerate(part):
            seq[j, : len(d)] = d
        seq = np.ascontiguousarray(seq.T)
        p = net.probabilities(seq)
        use = ~_MUTE[seq]
        p *= use[:, :, None]
        owner = np.array([i for i, _ in part])
        np.add.at(total, owner, p.sum(axis=0))
        np.add.at(count, owner, use.sum(axis=0))
    return total / np.maximum(count, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _cut(draws: dict[str, int]):
    """The segments of whole texts whose hash is below their language's draw (of 1 << 30)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, places, found = [], [], [], []
            for i, t, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_buffer()
                with np.errstate(over="ignore"):
                    chance = mix(np.arange(-(-raw.size // SEGMENT), dtype=np.uint64) + mix(np.array([i], dtype=np.int64).view(np.uint64)))
                for k in np.flatnonzero((chance >> U(34)) < draws.get(lang, 0)).tolist():
                    ids.append(i)
                    langs.append(lang)
                    places.append(int(chance[k] >> U(1)))
                    found.append(bytes(raw[k * SEGMENT : (k + 1) * SEGMENT]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "lang", "place", "segment"])

    return run


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many segments of each language to learn from, ``sample`` at most in all: FEW of each or all it has, and the rest in proportion."""
    few = max(1, min(FEW, sample // (2 * max(1, len(counts)))))
    rest, n = max(0, sample - sum(min(c, few) for c in counts.values())), sum(counts.values())
    return {x: min(c, few + rest * c // n) for x, c in counts.items()}


def learned(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """The network from at most ``sample`` segments of the documents (doc_id, text, lang) outside the held-out fold."""
    fold = labelled.bucket(F.col("doc_id"), FOLDS)
    rows = docs.filter((fold != HELD_OUT) & (fold >= 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    size = F.ceil(F.octet_length("text") / SEGMENT)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(size).cast("long").alias("n")).filter("n > 0").orderBy(F.desc("n"), "lang").limit(sample).collect()}
    most = quotas(counts, sample) if sum(counts.values()) > sample else counts
    # More than the quota is drawn, so that chance leaves enough; what is too much goes below.
    draws = {x: int((1 << 30) * min(1.0, (1.1 * q + 5 * q**0.5 + 10) / counts[x])) for x, q in most.items()}
    cut = materialise(rows.mapInArrow(_cut(draws), "doc_id long, lang string, place long, segment binary"), "segments")
    # Drawn are about 1.1 times the sample, so this is bounded as the sample is.
    got = sorted((r["doc_id"], r["place"], bytes(r["segment"]), r["lang"]) for r in cut.collect())
    release(cut)
    left, pairs = dict(most), []
    for i, place, segment, lang in sorted(got, key=lambda x: x[1:]):
        if left[lang] > 0:
            left[lang] -= 1
            pairs.append((i, place, segment, lang))
    pairs.sort()
    return train([s for _, _, s, _ in pairs], [x for _, _, _, x in pairs])


def _label(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(1)
                known = np.array([has_letter(t.as_py()) for t in texts]) & bool(net.languages)
                if len(net.languages) > 1:
                    p = predict(net, texts)
                else:
                    p = np.ones((len(texts), 1))
                best = p.argmax(axis=1)
                lang = [net.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang); lang is used for training only."""
    net = learned(docs, sample)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_label(net), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (labelled.bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
