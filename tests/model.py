"""A model of a store: a sorted map, and seeded random operations on it."""

import random


def operations(seed: int, n: int, ids: int = 40):
    """Lists of (kind, key, value): batches of 1 to 16, three in ten of them deletes, some keys written more than once."""
    rng = random.Random(seed)
    for step in range(n):
        batch = []
        for i in range(rng.randint(1, 16)):
            key = rng.randrange(ids).to_bytes(8, "big")
            batch.append(("remove", key, None) if rng.random() < 0.3 else ("record", key, f"{seed}.{step}.{i}".encode()))
        if rng.random() < 0.25:
            key = rng.randrange(ids).to_bytes(8, "big")
            batch += [("record", key, b"first"), ("remove", key, None), ("record", key, b"last")]
        yield batch


def apply(model: dict, batch) -> dict:
    out = dict(model)
    for kind, key, value in batch:
        if kind == "record":
            out[key] = value
        else:
            out.pop(key, None)
    return out


def between(model: dict, lower=None, upper=None, reverse=False):
    return sorted(((k, v) for k, v in model.items() if (lower is None or k >= lower) and (upper is None or k < upper)), reverse=reverse)
