"""Settings: typed, with defaults, readable from ``key=value`` text."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

STRATEGIES = ("base", "pnr", "prpd", "bnr", "flow")


@dataclass(frozen=True)
class Options:
    """What a skew join can be told.

    ``strategy`` is one of STRATEGIES. ``ratio`` is the share of a side's rows over which a key is
    heavy, ``floor`` the count under which it never is. ``tolerance`` is the tolerated (max - min) / max
    of heavy rows over buckets in balanced spreading. ``consensus`` takes only keys that every
    sender finds heavy. ``capacity`` bounds the online sketch, ``update_every`` is the number of rows of a
    key between re-picks of its target in the sequential balancer.
    """

    strategy: str = "bnr"
    buckets: int = 3
    ratio: float = 0.001
    floor: int = 10
    tolerance: float = 0.3
    consensus: bool = True
    online: bool = True
    capacity: int = 50
    update_every: int = 20


#: Names of settings files, and the option each sets.
NAMES = {"hj_type": "strategy", "node_nums": "buckets", "frequency_threshold": "ratio", "balance_factor": "tolerance", "enable_ld_sketch": "consensus", "dynamic_detect": "online", "histogram_capacity": "capacity", "update_frequency": "update_every"}


def parse(text: str) -> dict[str, str]:
    """Tokens ``key=value`` separated by white space; # starts a comment token, the first value of a key wins."""
    out: dict[str, str] = {}
    for token in text.split():
        key, eq, value = token.partition("=")
        if eq and not token.startswith("#"):
            out.setdefault(key, value)
    return out


def of(text: str) -> Options:
    """Options of settings text; keys that aren't options are ignored."""
    kinds = {f.name: type(f.default) for f in fields(Options)}
    got = {}
    for key, value in parse(text).items():
        name = NAMES.get(key, key)
        if name == "strategy":
            got[name] = STRATEGIES[int(value)] if value.isdigit() else value
        elif name in kinds:
            got[name] = value not in ("0", "false") if kinds[name] is bool else kinds[name](value)
    return Options(**got)


def read(path: str) -> Options:
    """Options of a settings file."""
    return of(Path(path).read_text())
