"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, batched decoding, storage."""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

import numpy as np

from factloom.llm.personal_rules import KINDS

TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
FLAGS = 4  # none, given, family, both
#: Added to the score of each step from no item into one: an item unseen costs more than one too many, as edges are checked.
LEAN = 2.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def alphabet(texts: list[str], most: int = 400) -> dict[str, int]:
    """Ids of the characters seen in training, the most frequent ones; 0 is padding, 1 any other character."""
    seen: dict[str, int] = {}
    for t in texts:
        for c in t:
            seen[c] = seen.get(c, 0) + 1
    return {c: k + 2 for k, (c, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]) if n > 2}


class Tagger:
    def __init__(self, chars: dict[str, int], hidden: int = 40, emb: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        k, h = len(TAGS), hidden
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.chars = chars
        self.p = {"E": (rng.standard_normal((len(chars) + 2, emb)) * 0.3).astype(np.float32), "L": (rng.standard_normal((FLAGS, emb)) * 0.3).astype(np.float32)}
        for d in "fb":
            self.p |= {f"Wx{d}": r(emb, 4 * h), f"Wh{d}": r(h, 4 * h), f"b{d}": np.zeros(4 * h, np.float32)}
            self.p[f"b{d}"][h : 2 * h] = 1.0
        self.p |= {"Wo": r(2 * h, k), "bo": np.zeros(k, np.float32), "A": np.zeros((k, k), np.float32)}
        for i, a in enumerate(TAGS):  # I-x follows B-x or I-x only
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.p["A"][i, j] = -8.0

    # One direction over (T, B) inputs; keeps what the backward pass needs.
    def _run(self, xi: np.ndarray, li: np.ndarray, d: str, keep: bool):
        p, h = self.p, self.p[f"Wh{d}"].shape[0]
        table, flags = p["E"] @ p[f"Wx{d}"], p["L"] @ p[f"Wx{d}"] + p[f"b{d}"]
        steps, n = xi.shape
        hs = np.zeros((steps + 1, n, h), np.float32)
        c = np.zeros((n, h), np.float32)
        saved = []
        for t in range(steps):
            z = table[xi[t]] + flags[li[t]] + hs[t] @ p[f"Wh{d}"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            new = f * c + i * g
            live = (xi[t] > 0)[:, None]
            new = np.where(live, new, 0)  # padding resets the state, so both directions start clean
            tc = np.tanh(new)
            hs[t + 1] = np.where(live, o * tc, 0)
            if keep:
                saved.append((i, f, o, g, c, tc, live))
            c = new
        return hs, saved

    @cached_property
    def _lookup(self) -> np.ndarray:
        out = np.ones(max(map(ord, self.chars)) + 2, np.int32)
        out[[ord(c) for c in self.chars]] = list(self.chars.values())
        return out

    def ids(self, text: str) -> np.ndarray:
        """Id of each character of a text."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._lookup[np.minimum(points, len(self._lookup) - 1)]

    def decode(self, ids: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each sequence by Viterbi over the CRF, given its character ids and lexicon flags; longest first.

        Both directions go in one step. A sequence that has ended leaves the batch, so that nothing is padded. Of the
        gates only tanh is needed: the state is kept twice as large, as sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        p, h = self.p, self.p["Whf"].shape[0]
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * h, h])
        table = np.concatenate([((p["E"] @ p[f"Wx{d}"])[:, None] + p["L"] @ p[f"Wx{d}"] + p[f"b{d}"]).reshape(-1, 4 * h) * half for d in "fb"])
        w = np.stack([p[f"Wh{d}"] * half / 2 for d in "fb"])
        size = np.array([len(v) for v in ids])
        steps, n = int(size[0]), len(ids)
        rows = np.zeros((steps, 2, n), np.int32)  # of the table; the second direction's are its second half
        for k, (v, f) in enumerate(zip(ids, flags)):
            own = v * FLAGS + f
            rows[: len(own), 0, k], rows[: len(own), 1, k] = own, own[::-1] + len(table) // 2
        live = np.searchsorted(-size, -np.arange(steps), side="left").tolist()  # sequences longer than t
        hs, c = np.zeros((steps + 1, 2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        z, u = np.empty((2, n, 4 * h), np.float32), np.empty_like(c)
        for t in range(steps):
            if (m := live[t]) < z.shape[1]:
                c, z, u = c[:, :m].copy(), z[:, :m].copy(), u[:, :m].copy()
            np.matmul(hs[t, :, :m], w, out=z)
            z += table[rows[t, :, :m]]
            np.tanh(z, out=z)
            z[:, :, : 3 * h] += 1
            c *= z[:, :, h : 2 * h]
            c *= 0.5
            c += np.multiply(z[:, :, :h], z[:, :, 3 * h :], out=u)
            np.tanh(np.multiply(c, 0.5, out=u), out=u)
            np.multiply(u, z[:, :, 2 * h : 3 * h], out=hs[t + 1, :, :m])
        mirrored = np.maximum(size - 1 - np.arange(steps)[:, None], 0)
        e = hs[1:, 0] @ (p["Wo"][:h] / 2) + np.take_along_axis(hs[1:, 1] @ (p["Wo"][h:] / 2), mirrored[:, :, None], 0) + p["bo"]
        return self._viterbi(np.ascontiguousarray(e.transpose(0, 2, 1)), size, live)

    def _viterbi(self, score: np.ndarray, size: np.ndarray, live: list[int]) -> list[np.ndarray]:
        """Best tags given (T, tags, B) scores, which are overwritten by those of the best paths."""
        a, steps = self.p["A"].copy(), len(score)
        for j, tag in enumerate(TAGS):
            if tag[0] == "B":
                a[0, j] += LEAN
        for t in range(1, steps):
            score[t, :, : live[t]] += (score[t - 1, :, None, : live[t]] + a[:, :, None]).max(0)
        out, m = np.zeros((steps, len(size)), np.int8), 0
        for t in range(steps - 1, -1, -1):
            if m:
                out[t, :m] = (score[t, :, :m] + a[:, out[t + 1, :m]]).argmax(0)
            if live[t] > m:
                out[t, m : live[t]] = score[t, :, m : live[t]].argmax(0)
            m = live[t]
        return [out[:n, k] for k, n in enumerate(size.tolist())]

    def loss(self, x: np.ndarray, flags: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF negative log likelihood a character, and its gradients."""
        p = self.p
        hf, sf = self._run(x, flags, "f", True)
        hb, sb = self._run(x[::-1], flags[::-1], "b", True)
        feats = np.concatenate([hf[1:], hb[1:][::-1]], 2)
        e = (feats @ p["Wo"] + p["bo"]).astype(np.float64)
        a = p["A"].astype(np.float64)
        steps, n, k = e.shape
        live = x > 0
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        lse = lambda v, ax: (m := v.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(ax))
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = np.where(live[t][:, None], lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(live[t + 1][:, None], lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        z = lse(alpha[-1], 1)
        post = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        gold = np.zeros_like(e)
        tt, bb = np.nonzero(live)
        gold[tt, bb, y[tt, bb]] = 1
        count = live.sum()
        de = ((post - gold) / count).astype(np.float32)
        da = np.zeros_like(a)
        for t in range(1, steps):
            on = live[t]
            if on.any():
                pair = np.exp(alpha[t - 1][on][:, :, None] + a[None] + (e[t] + beta[t])[on][:, None, :] - z[on][:, None, None]).sum(0)
                np.add.at(da, (y[t - 1][on], y[t][on]), -1.0)
                da += pair
        value = (z.sum() - (e[tt, bb, y[tt, bb]].sum() + sum(a[y[t - 1][live[t]], y[t][live[t]]].sum() for t in range(1, steps)))) / count
        g = {"A": (da / count).astype(np.float32), "Wo": np.tensordot(feats, de, ((0, 1), (0, 1))), "bo": de.sum((0, 1)), "E": np.zeros_like(p["E"]), "L": np.zeros_like(p["L"])}
        dfeats = de @ p["Wo"].T
        h = hf.shape[2]
        for d, hs, saved, dh_all, xs, fs in (("f", hf, sf, dfeats[:, :, :h], x, flags), ("b", hb, sb, dfeats[::-1, :, h:], x[::-1], flags[::-1])):
            dz_all = np.zeros((steps, n, 4 * h), np.float32)
            dh_next, dc_next = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            gw = np.zeros_like(p[f"Wh{d}"])
            for t in range(steps - 1, -1, -1):
                i, f, o, gg, c, tc, on = saved[t]
                dh = np.where(on, dh_all[t] + dh_next, 0)
                dc = np.where(on, dh * o * (1 - tc * tc) + dc_next, 0)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dz_all[t] = dz
                gw += hs[t].T @ dz
                dh_next, dc_next = dz @ p[f"Wh{d}"].T, dc * f
            flat = dz_all.reshape(-1, 4 * h)
            by_char, by_flag = np.zeros((len(p["E"]), 4 * h), np.float32), np.zeros((FLAGS, 4 * h), np.float32)
            for into, ids in ((by_char, xs.ravel()), (by_flag, fs.ravel())):
                order = np.argsort(ids, kind="stable")
                own, starts = np.unique(ids[order], return_index=True)
                into[own] = np.add.reduceat(flat[order], starts, 0)
            g[f"Wh{d}"], g[f"b{d}"] = gw, flat.sum(0)
            g[f"Wx{d}"] = p["E"].T @ by_char + p["L"].T @ by_flag
            g["E"] += by_char @ p[f"Wx{d}"].T
            g["L"] += by_flag @ p[f"Wx{d}"].T
        return float(value), g

    def mean_loss(self, batches, pool=None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean of `loss` over batches of equal size, computed in the processes of `pool`."""
        jobs = [(self, b) for b in batches]
        done = pool.map(_loss, jobs) if pool else list(map(_loss, jobs))
        return sum(v for v, _ in done) / len(done), {k: sum(g[k] for _, g in done) / np.float32(len(done)) for k in self.p}

    def fit(self, batches, rate: float = 4e-3, log=None, pool=None, at_once: int = 1) -> None:
        """Adam over an iterator of (x, flags, y) batches, `at_once` of them a step."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        batches = list(batches) if not hasattr(batches, "total") else batches
        total = (getattr(batches, "total", None) or len(batches)) // at_once
        stream = iter(batches)
        for step in range(1, total + 1):
            value, g = self.mean_loss([next(stream) for _ in range(at_once)], pool)
            norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
            scale = min(1.0, 0.5 / (norm + 1e-9))
            now = rate * min(1, step / 50) * (1 - 0.95 * step / total)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k] * scale
                v[k] = 0.999 * v[k] + 0.001 * (g[k] * scale) ** 2
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if log and step % 100 == 0:
                log(f"step {step}: loss {value:.5f}")

    def save(self, path: Path) -> None:
        np.savez_compressed(path, chars=np.array(list(self.chars)), **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: Path) -> Tagger:
        with np.load(path) as z:
            out = cls.__new__(cls)
            out.chars = {c: k + 2 for k, c in enumerate(z["chars"].tolist())}
            out.p = {k: z[k].astype(np.float32) for k in z.files if k != "chars"}
        return out


def _loss(job: tuple[Tagger, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    tagger, batch = job
    return tagger.loss(*batch)
