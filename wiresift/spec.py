"""What to look for, and where: rules and inspection options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from re import _parser as re_parser

from wiresift import dialect

# Direction names, and the order in which modes are tried.
CTS, STC, ANY = "CTS", "STC", "ANY"
MODE_ORDER = {"regex": 0, "fuzzy": 1, "bytesig": 2, "signature": 3}
DEFAULT_THRESHOLD = 75
DEFAULT_POST_PACKETS = 5
# Parse nodes whose match depends on the text around it.
CONTEXT_NODES = {
    "AT", "ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS", "POSSESSIVE_REPEAT", "ATOMIC_GROUP"}
OUTPUT_MODES = ("quiet", "meta", "hex", "print", "raw")


@dataclass(frozen=True)
class SignatureString:
    """One string of a signature rule; ``kind`` is text, hex or regex."""

    id: str
    kind: str
    pattern: str

    def __post_init__(self) -> None:
        if self.kind not in ("text", "hex", "regex"):
            raise ValueError(f"unknown signature string kind {self.kind!r}")
        if self.kind == "regex":
            re.compile(self.pattern)
            dialect.java(self.pattern, "s")
        elif self.kind == "hex":
            bytes.fromhex(self.pattern)
        if not self.pattern:
            raise ValueError("a signature string is empty")


@dataclass(frozen=True)
class Rule:
    """One content rule.

    ``pattern`` holds the regex, the fuzzy text, or (bytesig) hex digits.
    Patterns are Python's, over bytes: text beyond ASCII stands for its UTF-8
    bytes. ``flags`` uses the inline regex letters: ``s`` and ``m`` are on unless
    the caller drops them, ``i`` ignores case. A signature rule names its strings
    and a condition: ``any``, ``all`` or a count.
    """

    rule_id: int
    mode: str = "regex"
    pattern: str = ""
    direction: str = ANY
    priority: int = 0
    flags: str = "sm"
    threshold: int = DEFAULT_THRESHOLD
    namespace: str = "default"
    rule_name: str = ""
    source_file: str = ""
    condition: str = "any"
    strings: tuple[SignatureString, ...] = ()
    meta: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in MODE_ORDER:
            raise ValueError(f"unknown inspection mode {self.mode!r}")
        if self.direction not in (CTS, STC, ANY):
            raise ValueError(f"unknown direction {self.direction!r}")
        if self.mode == "regex":
            re.compile(self.pattern)
            dialect.java(self.pattern, self.flags)
        if self.mode == "fuzzy" and not (self.pattern and 1 <= self.threshold <= 100):
            raise ValueError("a fuzzy rule needs a text and a threshold from 1 to 100")
        if self.mode == "bytesig":
            bytes.fromhex(self.pattern)
        if self.mode == "signature":
            if not self.strings:
                raise ValueError("a signature rule needs strings")
            if not 1 <= self.needed_strings() <= len(self.strings):
                raise ValueError(f"the condition {self.condition!r} does not fit {len(self.strings)} strings")

    @property
    def byte_pattern(self) -> str:
        """The pattern's UTF-8 bytes, one character each, as buffers are searched."""
        return dialect.byte_pattern(self.pattern)

    def needed_strings(self) -> int:
        """How many distinct strings must occur for a signature rule to hold."""
        if self.condition == "any":
            return 1
        if self.condition == "all":
            return len(self.strings)
        return int(self.condition)

    @property
    def order(self) -> tuple[int, int, int]:
        return MODE_ORDER[self.mode], self.priority, self.rule_id

    def covers(self, direction: str) -> bool:
        return self.direction in (ANY, direction)


@dataclass(frozen=True)
class InspectSpec:
    """Options of one inspection run.

    ``max_streams``, ``max_datagrams`` and ``max_chunks`` bound what is inspected, the
    ``max_disp_`` ones what is displayed; 0 means all. ``output_modes`` are the forms in
    which matches are displayed. ``extract`` asks for all packets of matched flows, and
    ``post_packets`` for those up to so many after a match.
    """

    rules: tuple[Rule, ...] = ()
    offset: int = 0
    depth: int = 0
    invert: bool = False
    multi_match: bool = False
    linemode: bool = False
    max_streams: int = 0
    max_datagrams: int = 0
    max_chunks: int = 0
    max_disp_streams: int = 0
    max_disp_datagrams: int = 0
    max_disp_bytes: int = 0
    output_modes: tuple[str, ...] = ("meta", "hex")
    extract: bool = False
    post_packets: int | None = None
    drop_empty: bool = False
    ordered: tuple[Rule, ...] = field(default=(), init=False)

    def __post_init__(self) -> None:
        unknown = [m for m in self.output_modes if m not in OUTPUT_MODES]
        if unknown:
            raise ValueError(f"unknown output modes {unknown}")
        object.__setattr__(self, "ordered", tuple(sorted(self.rules, key=lambda r: r.order)))

    def for_direction(self, direction: str) -> tuple[Rule, ...]:
        return tuple(r for r in self.ordered if r.covers(direction))

    def directions(self) -> tuple[str, ...]:
        """Directions worth collecting: all in line mode or for byte signatures."""
        if self.linemode or any(r.mode == "bytesig" and r.direction == ANY for r in self.rules):
            return CTS, STC
        return tuple(d for d in (CTS, STC) if self.for_direction(d))


def normalise(spec: InspectSpec) -> InspectSpec:
    """Resolve options that exclude each other.

    Without rules the run is in line mode, which ignores offset, depth and
    invert. The post-match packet quota does not combine with line mode or
    with several matches per stream: whole flows are extracted instead.
    """
    if not spec.rules:
        spec = replace(spec, linemode=True)
    if spec.post_packets is not None and (spec.linemode or spec.multi_match):
        spec = replace(spec, post_packets=None, extract=True)
    if spec.linemode:
        spec = replace(spec, rules=(), offset=0, depth=0, invert=False)
    return spec


def widest_match(pattern: str) -> int | None:
    """Most characters one match can take, or None if there is no such bound.

    Patterns that look at the text around a match (anchors, word boundaries,
    look-around, back references) also give None: whether they hold cannot be
    decided from the matched characters alone.
    """
    parsed = dialect.parsed(pattern)
    if not context_free(pattern):
        return None
    widest = parsed.getwidth()[1]
    return None if widest >= 2**31 else int(widest)


def context_free(pattern: str) -> bool:
    """Whether matches depend on the matched characters alone."""
    return not _looks_around(dialect.parsed(pattern))


def _looks_around(node: object) -> bool:
    if isinstance(node, re_parser.SubPattern):
        return any(_looks_around(item) for item in node)
    if isinstance(node, (tuple, list)):
        return any(_looks_around(item) for item in node)
    return str(node) in CONTEXT_NODES
