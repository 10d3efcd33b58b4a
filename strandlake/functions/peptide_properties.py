"""Physico-chemical properties of peptides as closed column expressions over residue counts.

Null for a peptide with any residue outside the twenty standard ones; an empty peptide or one that is
not upper-case letters raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STANDARD = "ACDEFGHIKLMNPQRSTVWY"

#: Average residue masses (Da) and that of water.
MASS = dict(A=71.0788, R=156.1875, N=114.1038, D=115.0886, C=103.1388, E=129.1155, Q=128.1307, G=57.0519, H=137.1411, I=113.1594, L=113.1594, K=128.1741, M=131.1926, F=147.1766, P=97.1167, S=87.0782, T=101.1051, W=186.2132, Y=163.1760, V=99.1326)
WATER = 18.01524

#: Kyte-Doolittle hydropathy.
HYDROPATHY = dict(A=1.8, R=-4.5, N=-3.5, D=-3.5, C=2.5, Q=-3.5, E=-3.5, G=-0.4, H=-3.2, I=4.5, L=3.8, K=-3.9, M=1.9, F=2.8, P=-1.6, S=-0.8, T=-0.7, W=-0.9, Y=-1.3, V=4.2)

#: Boman's solubility scale.
BOMAN = dict(L=4.92, I=4.92, V=4.04, F=2.98, M=2.35, W=2.33, A=1.81, C=1.28, G=0.94, P=0.0, Y=-0.14, T=-2.57, S=-3.40, H=-4.66, Q=-5.54, K=-5.55, N=-6.64, E=-6.81, D=-8.72, R=-14.92)

#: Reversed-phase retention coefficients (minutes; Goloborodko et al. 2010), length correction and shift.
RETENTION = dict(A=6.73, C=3.25, D=5.64, E=5.66, F=27.43, G=2.35, H=-0.66, I=20.50, K=-4.47, L=23.38, M=17.39, N=2.57, P=5.66, Q=2.93, R=-2.55, S=3.58, T=4.88, V=13.05, W=31.27, Y=13.22)
LENGTH_CORRECTION, RETENTION_SHIFT = -0.21, 0.53

#: Dipeptide instability weights (Guruprasad 1990, as in R's Peptides); all others weigh 1.
INSTABILITY = {
    58.28: "MH RR RW",
    44.94: "AC EC HI HY IE MP MS NI QS RS SP YM",
    33.6: "CH CM CT EE FY KM KR LQ SC",
    24.68: "CW HK HN KQ LW MY NK WH WM YA YD",
    20.26: "AP CD CL CP DS ED EI EP EQ ES FP IL LP LR PA PF PP PQ PS PV QD QE QP QQ RH RP RQ SE SQ SR SS TE VP",
    18.38: "PE",
    13.34: "FD GG GW IH MA RN TF WL WN YH YP YY",
    -1.88: "HP HW IP MM MT NC NP PW VK",
    -6.54: "CQ CV DF DR EH GE HT KP MQ MR NQ PC PD PM PR QC QF QV QY RY TQ VY YE",
    -7.49: "AD AH DK GA GI GK GN GT GY IK IV KG KI KL KV LK NT RG TG VG VT WV YG YT",
    -9.37: "HF HG NW WG YW",
    -14.03: "DT EW FK NF NG TN TW VD WA WT",
    -15.91: "YR",
}


@dataclass(frozen=True)
class PkScale:
    n_end: float
    c_end: float
    gains: dict[str, float]
    losses: dict[str, float]


#: pK scales.
EMBOSS = PkScale(8.6, 3.6, dict(K=10.8, R=12.5, H=6.5), dict(D=3.9, E=4.1, C=8.5, Y=10.1))
SILLERO = PkScale(8.2, 3.2, dict(K=10.4, R=12.0, H=6.4), dict(D=4.0, E=4.5, C=9.0, Y=10.0))


def counted(sequence: Column, residue: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(residue), F.lit("")))


def _weighted(sequence: Column, scale: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for residue in sorted(scale):
        total = total + counted(sequence, residue) * F.lit(float(scale[residue]))
    return total


def molecular_weight(sequence: Column) -> Column:
    return _weighted(sequence, MASS) + WATER


def hydrophobicity(sequence: Column) -> Column:
    return _weighted(sequence, HYDROPATHY) / F.length(sequence)


def boman_index(sequence: Column) -> Column:
    return -_weighted(sequence, BOMAN) / F.length(sequence)


def retention_time(sequence: Column) -> Column:
    return _weighted(sequence, RETENTION) * (1 + LENGTH_CORRECTION * F.log(F.length(sequence).cast("double"))) + RETENTION_SHIFT


def instability_index(sequence: Column) -> Column:
    # One literal map of the dipeptides that weigh other than 1.
    weights = F.create_map(*[F.lit(x) for value, listed in INSTABILITY.items() for pair in listed.split() for x in (pair, float(value))])
    pairs = F.transform(F.sequence(F.lit(1), F.length(sequence) - 1), lambda i: F.substring(sequence, i, F.lit(2)))
    total = F.when(F.length(sequence) > 1, F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(weights[p], F.lit(1.0)))).otherwise(F.lit(0.0))
    return F.lit(10.0) / F.length(sequence) * total


def _charge(counts: dict[str, Column], ph: Column, scale: PkScale) -> Column:
    total = 1 / (1 + F.pow(F.lit(10.0), ph - scale.n_end))
    for residue, pk in scale.gains.items():
        total = total + counts[residue] / (1 + F.pow(F.lit(10.0), ph - pk))
    total = total - 1 / (1 + F.pow(F.lit(10.0), F.lit(scale.c_end) - ph))
    for residue, pk in scale.losses.items():
        total = total - counts[residue] / (1 + F.pow(F.lit(10.0), F.lit(pk) - ph))
    return total


def net_charge(sequence: Column, ph: float = 7.0, scale: PkScale = SILLERO) -> Column:
    return _charge({r: counted(sequence, r) for r in "KRHDECY"}, F.lit(ph), scale)


def isoelectric_point(sequence: Column, scale: PkScale = EMBOSS) -> Column:
    """Bisection over pH 0 to 14 in 34 halvings, after which the interval is under 1e-9."""
    counts = F.array(*[counted(sequence, r) for r in "KRHDECY"])

    def halve(span: Column, _: Column) -> Column:
        middle = (span["low"] + span["high"]) / 2
        positive = _charge({r: F.element_at(span["n"], k + 1) for k, r in enumerate("KRHDECY")}, middle, scale) > 0
        return F.struct(F.when(positive, middle).otherwise(span["low"]).alias("low"), F.when(positive, span["high"]).otherwise(middle).alias("high"), span["n"].alias("n"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), counts.alias("n"))
    span = F.aggregate(F.sequence(F.lit(1), F.lit(34)), start, halve)
    return (span["low"] + span["high"]) / 2


def property_columns(sequence: Column) -> dict[str, Column]:
    """Each property as a column of its own, in the order of their table, so that those nobody asks for are not computed.

    They are meant for sequences of the standard residues; see standard().
    """
    inner = F.substring(sequence, F.lit(1), F.length(sequence) - 1)
    return {
        "length": F.length(sequence).cast("bigint"),
        "molecular_weight": molecular_weight(sequence),
        "isoelectric_point": isoelectric_point(sequence),
        "hydrophobicity": hydrophobicity(sequence),
        "instability_index": instability_index(sequence),
        "boman_index": boman_index(sequence),
        "charge": net_charge(sequence),
        "predicted_retention_time": retention_time(sequence),
        "missed_cleavages": F.regexp_count(inner, F.lit("[KR](?!P)")).cast("bigint"),
        "proline_count": counted(sequence, "P").cast("bigint"),
        "c_terminal_residue": F.right(sequence, F.lit(1)),
        "contains_cysteine": sequence.contains("C"),
        "contains_methionine": sequence.contains("M"),
        "contains_tryptophan": sequence.contains("W"),
        "n_terminal_glutamine_or_glutamate": F.left(sequence, F.lit(1)).isin("Q", "E"),
        "n_terminal_cysteine": sequence.startswith("C"),
        "contains_ng_motif": sequence.contains("NG"),
        "contains_dp_motif": sequence.contains("DP"),
    }


def standard(sequence: Column) -> Column:
    """Whether all residues are standard ones; an empty sequence or one with other than capital letters raises."""
    bad = F.when(~sequence.rlike("^[A-Z]+$"), F.raise_error(F.concat(F.lit("peptide sequence must be non-empty upper-case letters, got "), sequence)).cast("boolean"))
    return F.coalesce(bad, sequence.rlike(f"^[{STANDARD}]+$"))


def properties(sequence: Column) -> Column:
    """A struct of all eighteen properties, null for a sequence with other residues."""
    return F.when(standard(sequence), F.struct(*[c.alias(n) for n, c in property_columns(sequence).items()]))


def property_frame(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The columns of `rows` and every property, null where the sequence has other residues; each prunes alone."""
    ok = standard(F.col(sequence))
    return rows.select("*", *[F.when(ok, c).alias(n) for n, c in property_columns(F.col(sequence)).items()])
