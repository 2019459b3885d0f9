"""The forward pass of the character BiLSTM as one compiled graph.

The weights come from numpy training (``pii_train``); this module only writes them down as a graph of two nodes (embedding and
bidirectional LSTM) in the ONNX wire format, so that the onnxruntime kernel can score them.  Without onnxruntime
``pii.BiLstmCrf`` scores in numpy with the same results up to rounding.
"""

from __future__ import annotations

import numpy as np

# fixed values: numbers of the ONNX format
FLOAT, INT64 = 1, 7
ATTRIBUTE_INT, ATTRIBUTE_STRING = 2, 3
IR_VERSION, OPSET = 8, 14


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, int(d)) for d in a.shape) + _field(2, FLOAT) + _field(8, name) + _field(9, np.ascontiguousarray(a).tobytes())


def _value(name: str, kind: int, shape: tuple[str | int, ...]) -> bytes:
    dims = b"".join(_field(1, _field(2, s) if isinstance(s, str) else _field(1, s)) for s in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def _node(op: str, inputs: list[str], outputs: list[str], attributes: list[bytes] = []) -> bytes:
    return b"".join([*(_field(1, i) for i in inputs), *(_field(2, o) for o in outputs), _field(4, op), *(_field(5, a) for a in attributes)])


def graph(p: dict[str, np.ndarray]) -> bytes:
    """The model's bytes; inputs ``x`` (time, batch) of symbols and the first states ``h``, ``c``, output ``y`` (time, direction, batch, hidden)."""
    h = p["rec_f"].shape[0]

    def gates(a: np.ndarray) -> np.ndarray:
        """Columns from input, forget, output, update to the kernel's input, output, forget, update; then transposed."""
        i, f, o, u = np.split(a, 4, axis=-1)
        return np.concatenate([i, o, f, u], axis=-1).T.astype(np.float32)

    w = np.stack([gates(p["in_f"]), gates(p["in_b"])])
    r = np.stack([gates(p["rec_f"]), gates(p["rec_b"])])
    b = np.stack([np.concatenate([gates(p[f"bias_{d}"]), np.zeros(4 * h, np.float32)]) for d in "fb"])
    parts = {"table": p["table"], "W": w, "R": r, "B": b}
    nodes = [
        _node("Gather", ["table", "x"], ["a"]),
        _node("LSTM", ["a", "W", "R", "B", "", "h", "c"], ["y"], [_field(1, "hidden_size") + _field(3, h) + _field(20, ATTRIBUTE_INT), _field(1, "direction") + _field(4, "bidirectional") + _field(20, ATTRIBUTE_STRING)]),
    ]
    body = b"".join(
        [*(_field(1, n) for n in nodes), _field(2, "tagger"),
         *(_field(5, _tensor(k, a.astype(np.float32))) for k, a in parts.items()),
         _field(11, _value("x", INT64, ("time", "batch"))),
         *(_field(11, _value(s, FLOAT, (2, "batch", h))) for s in "hc"), _field(12, _value("y", FLOAT, ("time", 2, "batch", h)))]
    )
    return _field(1, IR_VERSION) + _field(7, body) + _field(8, _field(1, "") + _field(2, OPSET))


def session(p: dict[str, np.ndarray]):
    """A one-thread session over the weights, or None where onnxruntime is missing."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return ort.InferenceSession(graph(p), options, providers=["CPUExecutionProvider"])
