"""Rule documents: identifier namespaces, entry classifiers and header formats, validated and compiled to columns.

Patterns are written in Python's syntax; named groups are translated for Java, and every pattern is
compiled when its rule is made, so a bad one fails with its name.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path


def java(pattern: str) -> str:
    """The pattern in Java's syntax, with Unicode white space."""
    return "(?U)" + pattern.replace("(?P<", "(?<") if r"\s" in pattern else pattern.replace("(?P<", "(?<")


def _checked(pattern: str, what: str) -> str:
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"{what}: invalid pattern {pattern!r}: {error}") from error
    return pattern


@dataclass(frozen=True)
class Namespace:
    name: str
    pattern: str

    def __post_init__(self) -> None:
        _checked(self.pattern, self.name)


@dataclass(frozen=True)
class Classifier:
    """A label, the patterns that mean it, and the decorations whose removal means it."""

    name: str
    matches: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for p in (*self.matches, *self.prefixes, *self.suffixes):
            _checked(p, self.name)
        for p in self.prefixes:
            if not p.startswith("^"):
                raise ValueError(f"{self.name}: a removable prefix must start with ^: {p!r}")
        for p in self.suffixes:
            if not p.endswith("$"):
                raise ValueError(f"{self.name}: a removable suffix must end with $: {p!r}")
        if any(re.search(p, "") for p in (*self.prefixes, *self.suffixes)):
            raise ValueError(f"{self.name}: a removable pattern must not match nothing")


@dataclass(frozen=True)
class HeaderColumn:
    name: str
    pattern: str | None = None
    value: str | None = None
    kind: str = "string"
    values: tuple[tuple[str, str], ...] | None = None
    required: bool = False

    def __post_init__(self) -> None:
        if (self.pattern is None) == (self.value is None):
            raise ValueError(f"{self.name}: give a pattern or a value")
        if self.kind not in ("string", "integer", "number", "boolean"):
            raise ValueError(f"{self.name}: unknown type {self.kind}")
        if not re.fullmatch("[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"{self.name}: not a column name")
        if self.pattern is not None and re.compile(_checked(self.pattern, self.name)).groups < 1:
            raise ValueError(f"{self.name}: the pattern needs a group")


@dataclass(frozen=True)
class HeaderFormat:
    name: str
    detection: str
    columns: tuple[HeaderColumn, ...]

    def __post_init__(self) -> None:
        _checked(self.detection, self.name)
        names = [c.name for c in self.columns]
        if len(names) != len(set(names)):
            raise ValueError(f"{self.name}: column names must be unique")


#: Identifier namespaces; the first that fits counts.
NAMESPACES = (
    Namespace("uniprot", r"^(?:sp|tr)\|[^|\s]+\|[^|\s]+$"),
    Namespace("uniprot_bare", r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-[0-9]+)?$"),
    Namespace("pdb", r"^pdb\|[0-9A-Za-z]{4}\|[A-Za-z0-9]$"),
    Namespace("refseq", r"^(?:ref\|)?(?:AP|NP|XP|YP|ZP|WP)_[0-9]{6,}(?:\.[0-9]+)?(?:\|)?$"),
    Namespace("genbank", r"^(?:[A-Z]{3}[0-9]{5}|[A-Z]{2}[0-9]{6})(?:\.[0-9]+)?$"),
    Namespace("ensembl", r"^ENS[A-Z]{0,4}[GTP][0-9]{6,}(?:\.[0-9]+)?$"),
    Namespace("nextprot", r"^NX_[A-Z0-9]+$"),
)

#: Entry classifiers.
CLASSIFIERS = (
    Classifier("decoy", prefixes=("^REV_", "^DECOY_", "^reverse_")),
    Classifier("contaminant", prefixes=("^CON__", "^CON_", "^CONTAMINANT_", r"^(?P<keep>(?:sp|tr)\|)Cont_")),
    Classifier("entrapment", matches=(r"^sp\|[^|]+_p_target\|",)),
)

#: The registry's namespaces, which go before the others, and its classifiers.
REGISTRY_NAMESPACES = (Namespace("registry_sentinel", r"^aa\|"), Namespace("registry_contaminant", r"^(?:sp|tr)\|Cont_|^zh\|C[0-9]{4}_"))
REGISTRY_CLASSIFIERS = (
    Classifier("decoy", prefixes=("^REV_",)),
    Classifier("contaminant", matches=(r"^(?:sp|tr)\|Cont_", r"^zh\|C[0-9]{4}_")),
    Classifier("entrapment", suffixes=("_p_target$",)),
    Classifier("sentinel", matches=(r"^aa\|",)),
)

#: Header formats.
UNIPROTKB = HeaderFormat(
    "uniprotkb",
    r"^(?:sp|tr)\|[^\s|]+\|[^\s|]+_[^_\s]+(?:\s+.+)?$",
    (
        HeaderColumn("database", value="uniprotkb", required=True),
        HeaderColumn("review_status", r"^(sp|tr)\|", values=(("sp", "reviewed"), ("tr", "unreviewed")), required=True),
        HeaderColumn("accession", r"^(?:sp|tr)\|([^|]+)\|", required=True),
        HeaderColumn("entry_name", r"^(?:sp|tr)\|[^|]+\|([^\s]+)", required=True),
        HeaderColumn("entry_mnemonic", r"^(?:sp|tr)\|[^|]+\|([^\s]+)_[^_\s]+(?:\s|$)", required=True),
        HeaderColumn("organism_mnemonic", r"^(?:sp|tr)\|[^|]+\|[^\s]+_([^_\s]+)(?:\s|$)", required=True),
        HeaderColumn("protein_name", r"^(?:sp|tr)\|[^|]+\|[^\s]+\s+(.+?)(?:\sOS=|\sOX=|\sGN=|\sPE=|\sSV=|$)"),
        HeaderColumn("organism_name", r"(?:^|\s)OS=(.+?)(?:\sOX=|\sGN=|\sPE=|\sSV=|$)"),
        HeaderColumn("taxonomy_id", r"(?:^|\s)OX=([0-9]+)(?:\s|$)", kind="integer"),
        HeaderColumn("gene_name", r"(?:^|\s)GN=([^\s]+)(?:\s|$)"),
        HeaderColumn("protein_existence", r"(?:^|\s)PE=([0-9]+)(?:\s|$)", kind="integer"),
        HeaderColumn("sequence_version", r"(?:^|\s)SV=([0-9]+)(?:\s|$)", kind="integer"),
    ),
)
REFSEQ = HeaderFormat(
    "refseq",
    r"^ref\|(?:AP|NP|XP|YP|ZP|WP)_[0-9]{6,}(?:\.[0-9]+)?\|\s+.+$",
    (
        HeaderColumn("database", value="refseq", required=True),
        HeaderColumn("accession", r"^ref\|([^|]+)\|", required=True),
        HeaderColumn("protein_name", r"^ref\|[^|]+\|\s+(.+?)(?:\s+\[[^\[\]]+\]\s*$|$)", required=True),
        HeaderColumn("organism_name", r"\s+\[([^\[\]]+)\]\s*$"),
    ),
)
FORMATS = (UNIPROTKB, REFSEQ)


def load_classifiers(path: str | Path) -> tuple[Classifier, ...]:
    """Classifiers of a JSON rule document; errors name the file."""
    try:
        document = json.loads(Path(path).read_text())
        return tuple(
            Classifier(c["name"], tuple(c.get("match_patterns", ())), tuple(c.get("removable_prefix_patterns", ())), tuple(c.get("removable_suffix_patterns", ())))
            for c in document["classifiers"]
        )
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError(f"{path}: {error}") from error


def load_format(path: str | Path) -> HeaderFormat:
    """A header format of a JSON rule document; errors name the file."""
    try:
        document = json.loads(Path(path).read_text())
        columns = [
            HeaderColumn(c["name"], c.get("pattern"), c.get("value"), c.get("type", "string"), tuple(c["values"].items()) if c.get("values") else None, part == "required")
            for part in ("required", "optional")
            for c in document["columns"].get(part, [])
        ]
        return HeaderFormat(document["format"], document["detection_pattern"], tuple(columns))
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError(f"{path}: {error}") from error
