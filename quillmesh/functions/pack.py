"""Models as bytes: arrays in NumPy's own format, everything else as JSON; reading them runs no code."""

from __future__ import annotations

import io
import json

import numpy as np


def pack(fields: dict) -> bytes:
    arrays = {k: v for k, v in fields.items() if isinstance(v, np.ndarray)}
    rest = {k: v for k, v in fields.items() if k not in arrays}
    out = io.BytesIO()
    np.savez(out, __rest__=np.frombuffer(json.dumps(rest).encode(), np.uint8), **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        fields = {k: held[k] for k in held.files if k != "__rest__"}
        return fields | json.loads(held["__rest__"].tobytes())
