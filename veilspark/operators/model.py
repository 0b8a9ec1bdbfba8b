"""A sparse mixture-of-experts token classifier in numpy: what a scorer loads once in a worker.

Pre-norm transformer layers: banded bidirectional grouped-query attention with sink logits and
interleaved rotary positions (YaRN scaled), then top-k routed experts with clamped SwiGLU, then a
linear head.  Weights may be dense or affine-quantised groups.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np

#: fixed values of the activation
LIMIT, SLOPE = 7.0, 1.702


@dataclass(frozen=True)
class Shape:
    """Hyper-parameters of a model."""

    layers: int
    width: int
    heads: int
    kv_heads: int
    head_dim: int
    experts: int
    top_k: int
    inner: int
    radius: int
    vocabulary: int
    labels: tuple[str, ...]
    theta: float = 150_000.0
    factor: float = 1.0
    original_positions: int = 4096
    beta_fast: float = 32.0
    beta_slow: float = 1.0
    eps: float = 1e-5
    truncate: bool = False

    @classmethod
    def from_config(cls, config: dict) -> Shape:
        """From a model's config; labels in the order of their integer keys."""
        rope = config.get("rope_parameters") or config.get("rope_scaling") or {}
        names = config.get("id2label", {})
        return cls(
            config["num_hidden_layers"], config["hidden_size"], config["num_attention_heads"], config["num_key_value_heads"],
            config["head_dim"], config["num_local_experts"], config["num_experts_per_tok"], config["intermediate_size"],
            config.get("sliding_window", 128), config["vocab_size"], tuple(names[k] for k in sorted(names, key=int)),
            float(rope.get("rope_theta", config.get("rope_theta", 150_000.0))), float(rope.get("factor", 1.0)),
            int(rope.get("original_max_position_embeddings", 4096)), float(rope.get("beta_fast", 32.0)), float(rope.get("beta_slow", 1.0)),
            float(config.get("rms_norm_eps", 1e-5)), bool(rope.get("truncate", False)),
        )


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * weight


def yarn(shape: Shape) -> tuple[np.ndarray, float]:
    """Inverse frequencies and attention factor: slow turns interpolated, fast ones kept, a ramp between."""
    half = shape.head_dim // 2
    plain = shape.theta ** (-np.arange(half, dtype=np.float64) / half)
    if shape.factor <= 1:
        return plain.astype(np.float32), 1.0

    def place(turns: float) -> float:
        return shape.head_dim * math.log(shape.original_positions / (turns * 2 * math.pi)) / (2 * math.log(shape.theta))

    low, high = place(shape.beta_fast), place(shape.beta_slow)
    if shape.truncate:
        low, high = math.floor(low), math.ceil(high)
    low, high = max(low, 0), min(high, shape.head_dim - 1)
    ramp = np.clip((np.arange(half) - low) / max(high - low, 1e-3), 0, 1)
    return (plain / shape.factor * ramp + plain * (1 - ramp)).astype(np.float32), 0.1 * math.log(shape.factor) + 1.0


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Turns the pairs (2i, 2i+1) of the last axis; x is tokens x heads x dim."""
    out = np.empty_like(x)
    even, odd = x[..., 0::2], x[..., 1::2]
    out[..., 0::2] = even * cos[:, None] - odd * sin[:, None]
    out[..., 1::2] = odd * cos[:, None] + even * sin[:, None]
    return out


def dense_attention(q, k, v, sinks, radius, scale):
    """Attention with the whole score matrix; tokens see others at most radius away, and a sink without value."""
    n, heads, _ = q.shape
    group = heads // k.shape[1]
    k, v = np.repeat(k, group, 1), np.repeat(v, group, 1)
    scores = np.einsum("qhd,khd->hqk", q, k) * scale
    at = np.arange(n)
    scores[:, np.abs(at[:, None] - at[None, :]) > radius] = -np.inf
    top = np.maximum(scores.max(-1), sinks[:, None])
    weights = np.exp(scores - top[..., None])
    total = weights.sum(-1) + np.exp(sinks[:, None] - top)
    return np.einsum("hqk,khd->qhd", weights / total[..., None], v)


def banded_attention(q, k, v, sinks, radius, scale):
    """The same in blocks of queries, so work and memory grow with length times radius."""
    n, block = len(q), max(radius, 16)
    out = np.empty((n, q.shape[1], v.shape[2]), q.dtype)
    group = q.shape[1] // k.shape[1]
    for a in range(0, n, block):
        b = min(a + block, n)
        lo, hi = max(0, a - radius), min(n, b + radius)
        kk, vv = np.repeat(k[lo:hi], group, 1), np.repeat(v[lo:hi], group, 1)
        scores = np.einsum("qhd,khd->hqk", q[a:b], kk) * scale
        far = np.abs(np.arange(a, b)[:, None] - np.arange(lo, hi)[None, :]) > radius
        scores[:, far] = -np.inf
        top = np.maximum(scores.max(-1), sinks[:, None])
        weights = np.exp(scores - top[..., None])
        total = weights.sum(-1) + np.exp(sinks[:, None] - top)
        out[a:b] = np.einsum("hqk,khd->qhd", weights / total[..., None], vv)
    return out


def route(logits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best experts of each token and the softmax over just those."""
    best = np.argpartition(-logits, k - 1, axis=1)[:, :k]
    chosen = np.take_along_axis(logits, best, 1)
    weights = np.exp(chosen - chosen.max(1, keepdims=True))
    return best, weights / weights.sum(1, keepdims=True)


def swiglu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Clamped: gate at most 7, up within 7 of 0."""
    gate, up = np.minimum(gate, LIMIT), np.clip(up, -LIMIT, LIMIT)
    return gate / (1 + np.exp(-SLOPE * gate)) * (up + 1)


class Quantised:
    """A matrix (or a stack of them) in affine groups: packed words, scales and offsets by group."""

    def __init__(self, packed: np.ndarray, scales: np.ndarray, biases: np.ndarray, bits: int, group: int):
        self.packed, self.scales, self.biases, self.bits, self.group = packed, scales, biases, bits, group

    @classmethod
    def of(cls, w: np.ndarray, bits: int = 4, group: int = 64) -> Quantised:
        """Rounds each group to 2**bits steps between its ends."""
        parts = w.astype(np.float32).reshape(*w.shape[:-1], -1, group)
        low, high = parts.min(-1, keepdims=True), parts.max(-1, keepdims=True)
        scale = np.maximum((high - low) / (2**bits - 1), 1e-8)
        steps = np.rint((parts - low) / scale).astype(np.uint32).reshape(*w.shape[:-1], -1, 32 // bits)
        packed = (steps << (np.arange(32 // bits, dtype=np.uint32) * bits)).sum(-1, dtype=np.uint32)
        return cls(packed, scale[..., 0], low[..., 0], bits, group)

    def dense(self) -> np.ndarray:
        shifts = np.arange(32 // self.bits, dtype=np.uint32) * self.bits
        steps = (self.packed[..., None] >> shifts & np.uint32(2**self.bits - 1)).astype(np.float32)
        steps = steps.reshape(*self.packed.shape[:-1], -1, self.group)
        out = steps * self.scales[..., None].astype(np.float32) + self.biases[..., None].astype(np.float32)
        return out.reshape(*self.packed.shape[:-1], -1)

    @property
    def nbytes(self) -> int:
        return self.packed.nbytes + self.scales.nbytes + self.biases.nbytes


def _dense(w) -> np.ndarray:
    return w.dense() if isinstance(w, Quantised) else w


class Classifier:
    """Weights by name; ``logits`` scores the tokens of one line.

    Names: embed, norm, head_w, head_b and for layer l ``l.`` + norm_1, wq, bq, wk, bk, wv, bv, wo,
    bo, sinks, norm_2, router_w, router_b, gate_w, gate_b, up_w, up_b, down_w, down_b.
    """

    def __init__(self, shape: Shape, weights: dict, banded: bool = True, sorted_dispatch: bool = True):
        self.shape, self.w = shape, weights
        self.attention = banded_attention if banded else dense_attention
        self.sorted_dispatch = sorted_dispatch
        self.vocabulary, self.labels = shape.vocabulary, list(shape.labels)

    @property
    def weight_bytes(self) -> int:
        return sum(w.nbytes for w in self.w.values())

    def logits(self, ids: np.ndarray) -> np.ndarray:
        s, w = self.shape, self.w
        embed = w["embed"]
        x = Quantised(embed.packed[ids], embed.scales[ids], embed.biases[ids], embed.bits, embed.group).dense() if isinstance(embed, Quantised) else embed[ids].astype(np.float32)
        inverse, factor = yarn(s)
        angle = np.arange(len(ids), dtype=np.float32)[:, None] * inverse[None]
        cos, sin = np.cos(angle) * factor, np.sin(angle) * factor
        for layer in range(s.layers):
            g = lambda name, p=f"{layer}.": _dense(w[p + name])
            h = rms_norm(x, g("norm_1"), s.eps)
            q = (h @ g("wq").T + g("bq")).reshape(len(ids), s.heads, s.head_dim)
            k = (h @ g("wk").T + g("bk")).reshape(len(ids), s.kv_heads, s.head_dim)
            v = (h @ g("wv").T + g("bv")).reshape(len(ids), s.kv_heads, s.head_dim)
            seen = self.attention(rotate(q, cos, sin), rotate(k, cos, sin), v, g("sinks"), s.radius, s.head_dim**-0.5)
            x = x + seen.reshape(len(ids), -1) @ g("wo").T + g("bo")
            x = x + self._experts(rms_norm(x, g("norm_2"), s.eps), g, f"{layer}.")
        return (rms_norm(x, _dense(w["norm"]), s.eps) @ _dense(w["head_w"]).T + _dense(w["head_b"])).astype(np.float32)

    def _experts(self, h: np.ndarray, g, prefix: str) -> np.ndarray:
        best, share = route(h @ g("router_w").T + g("router_b"), self.shape.top_k)
        gate, up, down = (g(n) for n in ("gate_w", "up_w", "down_w"))
        gate_b, up_b, down_b = (g(n) for n in ("gate_b", "up_b", "down_b"))
        out = np.zeros_like(h)
        if not self.sorted_dispatch:
            for t in range(len(h)):
                for e, p in zip(best[t], share[t]):
                    out[t] += p * (swiglu(h[t] @ gate[e].T + gate_b[e], h[t] @ up[e].T + up_b[e]) @ down[e].T + down_b[e])
            return out
        token = np.repeat(np.arange(len(h)), best.shape[1])
        order = np.argsort(best.ravel(), kind="stable")
        expert, token, p = best.ravel()[order], token[order], share.ravel()[order]
        ends = np.searchsorted(expert, np.arange(self.shape.experts + 1))
        for e in np.unique(expert):
            rows = token[ends[e] : ends[e + 1]]
            y = swiglu(h[rows] @ gate[e].T + gate_b[e], h[rows] @ up[e].T + up_b[e]) @ down[e].T + down_b[e]
            np.add.at(out, rows, p[ends[e] : ends[e + 1], None] * y)
        return out


def random_weights(shape: Shape, seed: int = 0, scale: float = 0.1) -> dict:
    """Small random weights, for tests without a trained model."""
    rng = np.random.default_rng(seed)
    r = lambda *n: (rng.standard_normal(n) * scale).astype(np.float32)
    d, q, kv, n = shape.width, shape.heads * shape.head_dim, shape.kv_heads * shape.head_dim, len(shape.labels)
    out = {"embed": r(shape.vocabulary, d), "norm": 1 + r(d), "head_w": r(n, d), "head_b": r(n)}
    for k in range(shape.layers):
        sizes = {"wq": (q, d), "bq": (q,), "wk": (kv, d), "bk": (kv,), "wv": (kv, d), "bv": (kv,), "wo": (d, q), "bo": (d,), "sinks": (shape.heads,), "router_w": (shape.experts, d), "router_b": (shape.experts,)}
        sizes |= {"gate_w": (shape.experts, shape.inner, d), "gate_b": (shape.experts, shape.inner), "up_w": (shape.experts, shape.inner, d), "up_b": (shape.experts, shape.inner), "down_w": (shape.experts, d, shape.inner), "down_b": (shape.experts, d)}
        out |= {f"{k}.{name}": r(*size) for name, size in sizes.items()}
        out |= {f"{k}.norm_1": 1 + r(d), f"{k}.norm_2": 1 + r(d)}
    return out


_KINDS = {"F64": np.float64, "F32": np.float32, "F16": np.float16, "I64": np.int64, "I32": np.int32, "U32": np.uint32, "U8": np.uint8, "I8": np.int8, "BOOL": np.bool_}


def read_safetensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file: header length, JSON header, raw values; BF16 becomes float32."""
    size = int.from_bytes(data[:8], "little")
    head, out = json.loads(data[8 : 8 + size]), {}
    for name, t in head.items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            raw = data[8 + size + a : 8 + size + b]
            if t["dtype"] == "BF16":
                out[name] = (np.frombuffer(raw, np.uint16).astype(np.uint32) << 16).view(np.float32).reshape(t["shape"])
            else:
                out[name] = np.frombuffer(raw, _KINDS[t["dtype"]]).reshape(t["shape"])
    return out


def write_safetensors(tensors: dict[str, np.ndarray]) -> bytes:
    names, head, at, parts = {np.dtype(v): k for k, v in _KINDS.items()}, {}, 0, []
    for name, t in sorted(tensors.items()):
        raw = np.ascontiguousarray(t).tobytes()
        head[name] = {"dtype": names[t.dtype], "shape": list(t.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def flatten(weights: dict) -> dict[str, np.ndarray]:
    """Weights as plain tensors; a quantised one becomes name.weight, name.scales and name.biases."""
    out = {}
    for name, w in weights.items():
        out |= {f"{name}.weight": w.packed, f"{name}.scales": w.scales, f"{name}.biases": w.biases} if isinstance(w, Quantised) else {name: w}
    return out


def unflatten(tensors: dict[str, np.ndarray], bits: int | None = None, group: int = 64, quantization: dict | None = None) -> dict:
    """Inverse of ``flatten``; each tensor may have a width of its own.

    ``quantization`` is the block stored with a model (``bits``, ``group_size``, and such blocks under
    tensor names); it comes before the arguments.  Without either, a width follows from the shapes.
    """
    stored, out = quantization or {}, {}
    for name, t in tensors.items():
        base, _, part = name.rpartition(".")
        if f"{base}.scales" not in tensors:
            out[name] = t
        elif part == "weight":
            own = stored.get(base) if isinstance(stored.get(base), dict) else {}
            size = int(own.get("group_size", stored.get("group_size", group)))
            scales = tensors[f"{base}.scales"]
            width = own.get("bits", stored.get("bits", bits)) or 32 * t.shape[-1] // (scales.shape[-1] * size)
            if 32 * t.shape[-1] != int(width) * scales.shape[-1] * size:
                raise ValueError(f"{base}: {t.shape[-1]} words do not hold {scales.shape[-1]} groups of {size} at {width} bits")
            out[base] = Quantised(t, scales, tensors[f"{base}.biases"], int(width), size)
    return out


def from_checkpoint(tensors: dict[str, np.ndarray], shape: Shape) -> dict:
    """Internal names for a published checkpoint: joined gate-and-up tensors are turned and split (gate first)."""
    out = {"embed": tensors["model.embed_tokens.weight"], "norm": tensors["model.norm.weight"], "head_w": tensors["score.weight"], "head_b": tensors.get("score.bias", np.zeros(len(shape.labels), np.float32))}
    for k in range(shape.layers):
        p, q = f"model.layers.{k}.", f"{k}."
        for a, b in (("q", "q_proj"), ("k", "k_proj"), ("v", "v_proj"), ("o", "o_proj")):
            out[f"{q}w{a}"], out[f"{q}b{a}"] = tensors[f"{p}self_attn.{b}.weight"], tensors[f"{p}self_attn.{b}.bias"]
        out |= {f"{q}sinks": tensors[f"{p}self_attn.sinks"], f"{q}norm_1": tensors[f"{p}input_layernorm.weight"], f"{q}norm_2": tensors[f"{p}post_attention_layernorm.weight"]}
        out |= {f"{q}router_w": tensors[f"{p}mlp.router.weight"], f"{q}router_b": tensors[f"{p}mlp.router.bias"]}
        both, both_b = tensors[f"{p}mlp.experts.gate_up_proj"], tensors[f"{p}mlp.experts.gate_up_proj_bias"]
        n = shape.inner
        out |= {f"{q}gate_w": both[..., :n].swapaxes(1, 2), f"{q}up_w": both[..., n:].swapaxes(1, 2), f"{q}gate_b": both_b[..., :n], f"{q}up_b": both_b[..., n:]}
        out |= {f"{q}down_w": tensors[f"{p}mlp.experts.down_proj"].swapaxes(1, 2), f"{q}down_b": tensors[f"{p}mlp.experts.down_proj_bias"]}
    return out
