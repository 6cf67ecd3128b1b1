"""Column-level functions (native Catalyst expressions and higher-order functions)."""

from textkiln.functions.arrays import (  # noqa: F401
    append_eot,
    array_md5,
    count_valid,
    pad_to,
    repeat_ignore,
    tail,
)
from textkiln.functions.gates import clamp, sigmoid, softplus  # noqa: F401
from textkiln.functions.hashing import seeded_hash_hex, seeded_u32, uniform01  # noqa: F401
from textkiln.functions.text import hashed_piece_ids, pretokenize  # noqa: F401
from textkiln.functions.vectors import dot, l2_norm, rms_norm  # noqa: F401
