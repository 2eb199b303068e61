"""Hashes, encodings and protocol arithmetic as columns; Python only where a format has no SQL form."""

from __future__ import annotations

import hashlib
import json
import random
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyforge.config import DEFAULT


def be_bytes(number: Column, width: int) -> Column:
    """A non-negative integer as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), width * 2, "0"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a string."""
    return F.encode(text, "UTF-8")


def clean_hex(text: Column) -> Column:
    """Hex without 0x and blanks, padded on the left to whole bytes; empty for null."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "0[xX]", "")
    return F.when(F.length(s) % 2 == 1, F.concat(F.lit("0"), s)).otherwise(s)


def with_length(data: Column, width: int) -> Column:
    """Bytes behind their length."""
    return F.concat(be_bytes(F.octet_length(data), width), data)


def first_u64(digest_hex: Column) -> Column:
    """The first eight bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest_hex, 1, 16), 16, 10).cast("decimal(20,0)")


def prompt_range(randomness: Column, env: Column, universe: Column, size: int, domain: str = "prompt-range/v1") -> Column:
    """struct(lo, hi): the window's slice of the prompt index; everything if it is not larger than ``size``."""
    digest = F.sha2(text_bytes(F.concat(F.lit(domain + "|"), env, F.lit("|"), randomness)), 256)
    lo = (first_u64(digest) % F.greatest(universe - size, F.lit(1)).cast("decimal(20,0)")).cast("bigint")
    whole = universe <= size
    return F.struct(F.when(whole, 0).otherwise(lo).cast("bigint").alias("lo"), F.when(whole, universe).otherwise(lo + size).cast("bigint").alias("hi"))


def uniform_draw(randomness: Column, prompt: Column, checkpoint: Column, rollout: Column, t: Column, domain: str = "forced-seed-v2") -> Column:
    """The public uniform in [0, 1) of a position."""
    message = F.concat(F.lit(domain.encode()), with_length(text_bytes(randomness), 2), be_bytes(prompt, 8), with_length(text_bytes(checkpoint), 2), be_bytes(rollout, 4), be_bytes(t, 4))
    return first_u64(F.sha2(message, 256)).cast("double") / F.lit(2.0**64)


def token_hash(tokens: Column) -> Column:
    """sha256 of token ids as four big-endian bytes each."""
    return F.sha2(F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(t.cast("bigint")), 8, "0")), "")), 256)


def tiebreak(hotkey: Column, prompt: Column, root: Column) -> Column:
    """The order of submissions that arrive at the same instant."""
    return F.sha2(F.concat(text_bytes(hotkey), be_bytes(prompt, 8), root), 256)


def beacon_round(timestamp: Column, genesis: int, period: int) -> Column:
    """The beacon round in progress; 1 before genesis."""
    return F.when(timestamp < genesis, F.lit(1)).otherwise(1 + F.floor((timestamp - genesis) / period)).cast("bigint")


def round_at(timestamp: Column, genesis: int, period: int) -> Column:
    """The same count with 0 before genesis."""
    return F.when(timestamp < genesis, F.lit(0)).otherwise(beacon_round(timestamp, genesis, period)).cast("bigint")


def seconds_to_boundary(timestamp: Column, genesis: int, period: int) -> Column:
    """Seconds until the next round is published; 0 on a boundary."""
    rest = F.pmod(timestamp - genesis, F.lit(period))
    return F.when(timestamp < genesis, genesis - timestamp).when(rest == 0, 0.0).otherwise(period - rest).cast("double")


def window_randomness(block: Column, beacon: Column, round_: Column) -> Column:
    """sha256(block, beacon, round) in hex; the block alone without a beacon."""
    material = F.concat(F.unhex(clean_hex(block)), F.unhex(clean_hex(beacon)), F.coalesce(be_bytes(round_, 8), F.lit(b"")))
    return F.when(F.coalesce(beacon, F.lit("")) == "", F.replace(block, F.lit("0x"), F.lit(""))).otherwise(F.sha2(material, 256))


def beacon_valid(signature_hex: Column, randomness: Column) -> Column:
    """Whether the randomness is the digest of the signature."""
    return F.sha2(F.unhex(clean_hex(signature_hex)), 256) == F.lower(randomness)


def envelope_binding(hotkey: Column, window: Column, prompt: Column, root: Column, checkpoint: Column, round_: Column, randomness: Column, nonce: Column, domain: str = "envelope-v1", version: int | None = None) -> Column:
    """The digest that an envelope's signature covers: every field behind its length, the version only in wire v2."""
    parts = [text_bytes(hotkey), be_bytes(window, 8), be_bytes(prompt, 8), F.unhex(clean_hex(root)), text_bytes(F.coalesce(checkpoint, F.lit(""))), be_bytes(round_, 8)]
    if version is not None:
        parts.append(be_bytes(F.lit(version), 8))
    parts += [F.unhex(clean_hex(randomness)), text_bytes(F.coalesce(nonce, F.lit("")))]
    return F.sha2(F.concat(F.lit(domain.encode()), *[with_length(p, 4) for p in parts]), 256)


def sketch_tolerance(position: Column, base: int = DEFAULT.sketch_base, growth: float = DEFAULT.sketch_growth) -> Column:
    """The tolerance of a sketch at a position."""
    return F.floor(base + growth * F.sqrt(position)).cast("bigint")


def modular_distance(a: Column, b: Column, modulus: int = DEFAULT.sketch_modulus) -> Column:
    """The shorter way round between two residues."""
    d = F.abs(a - b)
    return F.least(d, modulus - d)


def problem_id(text: Column) -> Column:
    """16 hex digits of the text's digest."""
    return F.substring(F.sha2(text_bytes(text), 256), 1, 16)


def prf(label: bytes, *parts: bytes, out_bytes: int) -> bytes:
    """SHAKE-256 over the label and the parts, each behind its length in four bytes."""
    if not 0 <= out_bytes <= 1 << 16:
        raise ValueError("between 0 and 65536 bytes")
    message = b"".join(len(x).to_bytes(4, "big") + x for x in (label, *parts))
    return hashlib.shake_256(message).digest(out_bytes)


def hex_bytes(text: str | None) -> bytes:
    """The bytes of clean_hex, on the driver or in a worker."""
    digits = re.sub("0[xX]", "", (text or "").strip())
    return bytes.fromhex(digits.zfill(len(digits) + len(digits) % 2))


def coefficient_vector(randomness_hex: str, size: int, limit: int = 127, label: bytes = b"sketch") -> list[int]:
    """Bounded coefficients of a window, expanded on the driver with SHAKE-256; a literal of ``size`` numbers for the plan."""
    raw = prf(label, hex_bytes(randomness_hex), out_bytes=2 * size)
    words = [int.from_bytes(raw[k : k + 2], "big", signed=True) for k in range(0, 2 * size, 2)]
    return [abs(w) % (2 * limit + 1) - limit for w in words]


def projection_vector(randomness_hex: str, size: int, label: bytes = b"sketch") -> list[int]:
    """Signed 32-bit coefficients of a window, big-endian words of the same expansion."""
    if not hex_bytes(randomness_hex):
        raise ValueError("randomness is empty")
    raw = prf(label, hex_bytes(randomness_hex), out_bytes=4 * size)
    return [int.from_bytes(raw[k : k + 4], "big", signed=True) for k in range(0, 4 * size, 4)]


def canonical_json(value: Any) -> bytes:
    """JSON with sorted keys, no blanks and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def merkle_root(leaves: list[Any], leaf_domain: bytes = b"rollout-leaf\x00", node_domain: bytes = b"rollout-node\x00") -> str | None:
    """Root over canonical JSON leaves, domains apart; an odd node is paired with itself; None without leaves."""
    level = [hashlib.sha256(leaf_domain + canonical_json(x)).digest() for x in leaves]
    while len(level) > 1:
        pairs = zip(level[::2], level[1::2] + level[-1:] * (len(level) % 2))
        level = [hashlib.sha256(node_domain + a + b).digest() for a, b in pairs]
    return level[0].hex() if level else None


@pandas_udf(T.StringType())
def merkle_root_udf(leaves):  # noqa: ANN001, ANN201
    """Merkle roots of arrays of JSON texts, in order."""
    return leaves.map(lambda xs: merkle_root([json.loads(x) for x in xs]))


def legacy_root(leaves: list[Any]) -> str | None:
    """The root without domains, of whole bytes or canonical JSON leaves; an odd node is paired with itself."""
    return merkle_root(leaves, b"", b"")


def selection_digest(streams: list[list[int]], env: str, domain: bytes = b"selection-stream-v1\x00") -> str:
    """The digest of what a group generated (environment, index, tokens), which no harmless field can change."""
    if not streams:
        raise ValueError("a group has streams")
    return hashlib.sha256(domain + canonical_json([{"env_name": env, "index": k, "tokens": [int(t) for t in x]} for k, x in enumerate(streams)])).hexdigest()


@pandas_udf(T.StringType())
def selection_digest_udf(streams, env):  # noqa: ANN001, ANN201
    """Vector of selection_digest; null for an empty group."""
    return pd.Series([selection_digest([list(x) for x in s], e) if s is not None and len(s) else None for s, e in zip(streams, env)], dtype="object")


def root_matches(claimed: Column, root: Column) -> Column:
    """Whether a claimed root is the recomputed one, whatever its case; a missing one is not."""
    return F.coalesce(F.lower(claimed) == root, F.lit(False))


def length_prefixed(domain: str, *parts: Column) -> Column:
    """sha256 of a domain and parts, each behind its length in four bytes."""
    return F.sha2(F.concat(F.lit(domain.encode()), *[with_length(p, 4) for p in parts]), 256)


def commit_binding(tokens: Column, randomness: Column, model: Column, layer: Column, commitments_json: Column, domain: str = "commit-v1") -> Column:
    """The digest that a commit's signature covers; the layer is a signed number of four bytes."""
    layer_bytes = F.unhex(F.lpad(F.hex(layer.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return length_prefixed(domain, F.unhex(token_hash(tokens)), F.unhex(clean_hex(randomness)), text_bytes(F.coalesce(model, F.lit(""))), layer_bytes, F.unhex(F.sha2(text_bytes(commitments_json), 256)))


def precommit_binding(hotkey: Column, window: Column, prompt: Column, root: Column, checkpoint: Column, env: Column, size: Column, payload_sha: Column, round_: Column, randomness: Column, version: Column, nonce: Column, domain: str = "upload-precommit-v2") -> Column:
    """The digest that is signed before a body is sent: the envelope's fields, environment, byte count and digest of the body."""
    return length_prefixed(
        domain, text_bytes(hotkey), be_bytes(window, 8), be_bytes(prompt, 8), F.unhex(clean_hex(root)), text_bytes(F.coalesce(checkpoint, F.lit(""))), text_bytes(env),
        be_bytes(size, 8), F.unhex(clean_hex(payload_sha)), be_bytes(round_, 8), F.unhex(clean_hex(randomness)), be_bytes(version, 8), text_bytes(nonce),
    )


def environment_seed(wallet: Column, window_hash: Column, index: Column) -> Column:
    """The 32-bit seed of an environment: the first eight digits of a digest over wallet, window and problem index."""
    message = F.concat(F.lit("seed|"), wallet, F.lit(":"), window_hash, F.lit(":"), F.coalesce(index, F.lit(0)).cast("bigint").cast("string"))
    return F.conv(F.substring(F.sha2(text_bytes(message), 256), 1, 8), 16, 10).cast("bigint")


def challenge_indices(tokens: list[int], randomness_hex: str, start: int, stop: int, k: int = DEFAULT.challenge_positions) -> list[int]:
    """min(k, stop - start) sorted positions of [start, stop), from CPython's generator seeded by the PRF of tokens and randomness.

    The wire format asks for two ways to draw: a sample where the positions are under a tenth of the range, else the head
    of a shuffled range.
    """
    if start < 0 or stop < start or k <= 0 or not tokens or not hex_bytes(randomness_hex):
        raise ValueError("a range, a positive number, tokens and randomness are needed")
    if stop == start:
        return []
    digest = hashlib.sha256(b"".join((int(t) & 0xFFFFFFFF).to_bytes(4, "big") for t in tokens)).digest()
    draw = random.Random(prf(b"open", digest, hex_bytes(randomness_hex), out_bytes=32))
    places, wanted = range(start, stop), min(k, stop - start)
    if 10 * wanted < len(places):
        return sorted(draw.sample(places, wanted))
    shuffled = list(places)
    draw.shuffle(shuffled)
    return sorted(shuffled[:wanted])


@pandas_udf(T.ArrayType(T.LongType()))
def challenge_udf(tokens, randomness, start, stop):  # noqa: ANN001, ANN201
    """Vector of challenge_indices."""
    return pd.Series([challenge_indices(list(t), r, int(a), int(b)) for t, r, a, b in zip(tokens, randomness, start, stop)])
