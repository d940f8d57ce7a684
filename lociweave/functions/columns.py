"""Column functions for identifiers, alleles, effects and bins.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gene_number(gene_id: Column) -> Column:
    """ENSG00000012345.6 -> 12345; null if the id has another form."""
    return F.regexp_extract(gene_id, r"^ENSG([0-9]+)(?:\.[0-9]+)?$", 1).try_cast("int")


def gene_id(number: Column) -> Column:
    """12345 -> ENSG00000012345."""
    return F.printf(F.lit("ENSG%011d"), number)


def variant_part(variant_id: Column, part: str) -> Column:
    """chrom, pos, ref, alt or build of an id chrom_pos_ref_alt_build."""
    place = {"chrom": 1, "pos": 2, "ref": 3, "alt": 4, "build": 5}[part]
    found = F.try_element_at(F.split(variant_id, "_"), F.lit(place))
    return found.try_cast("int") if part == "pos" else found


def chromosome(code: Column) -> Column:
    """X -> 23, numbers as they are, anything else null."""
    bare = F.regexp_replace(code, "^chr", "")
    return F.when(bare == "X", F.lit(23)).otherwise(bare.try_cast("int"))


def flip_flag(ref: Column, alt: Column) -> Column:
    """1 if the reference allele sorts before the alternative one."""
    return (ref < alt).cast("int")


def flip_effect(effect: Column, flag: Column) -> Column:
    """The effect with its sign changed where the flag is 1."""
    return F.when(flag == 1, -effect).otherwise(effect)


def log_effect(odds_ratio: Column, ref: Column, effect_allele: Column) -> Column:
    """Natural log of the odds ratio, inverted where ref sorts before the effect allele."""
    return F.when(ref < effect_allele, -F.ln(odds_ratio)).otherwise(F.ln(odds_ratio))


def rs_number(rsid: Column) -> Column:
    """rs123 -> 123; null if the rest is no number."""
    return F.regexp_replace(rsid, "^rs", "").try_cast("int")


def rs_id(number: Column) -> Column:
    """123 -> rs123."""
    return F.concat(F.lit("rs"), number.cast("string"))


def symbol_count(text: Column, symbol: str) -> Column:
    """How often a one-character symbol occurs in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def t_statistic(effect: Column, error: Column) -> Column:
    """effect / error, null for a zero error."""
    return F.try_divide(effect, error)


def strip_version(accession: Column) -> Column:
    """An accession without its trailing .version."""
    return F.regexp_replace(accession, r"^(.+)\.[0-9]+$", "$1")


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it does not match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), found)


def locus_name(chrom: Column, pos: Column) -> Column:
    """chr{chrom}_{pos}."""
    return F.concat(F.lit("chr"), chrom.cast("string"), F.lit("_"), pos.cast("string"))


def cut_right(value: Column, breaks: list[float]) -> Column:
    """Number (from 1) of the interval (lo, hi] that holds the value, null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(breaks) - 1, 0, -1):
        out = F.when((value > breaks[i - 1]) & (value <= breaks[i]), F.lit(i)).otherwise(out)
    return out


def block_number(pos: Column, first: Column, size: int) -> Column:
    """1-based block of a position, blocks of ``size`` counted from just below ``first``."""
    return (F.floor((pos - first + 1) / F.lit(size)) + 1).cast("long")


def minus_log10(p: Column) -> Column:
    """-log10(p), null for p = 0."""
    return -F.log10(p)


def flip_dosage(values: Column, flag: Column, ploidy: int = 2) -> Column:
    """An array of dosages (ploidy 2) or haplotypes (1) counted for the other allele where the flag is 1."""
    return F.when(flag == 1, F.transform(values, lambda x: F.abs(F.lit(ploidy) - x))).otherwise(values)


def log_normal_density(x: Column, variance: Column) -> Column:
    """Log density at x of a normal distribution with mean 0."""
    import math

    return -x * x / (2 * variance) - F.ln(variance) / 2 - math.log(2 * math.pi) / 2


def normal_density(x: Column, variance: Column) -> Column:
    """Density at x of a normal distribution with mean 0."""
    return F.exp(log_normal_density(x, variance))


def categorical(values: Column) -> Column:
    """Whether all values of an array equal their one-decimal rounding."""
    return F.forall(values, lambda x: F.round(x, 1) == x)


def null_if_nan(x: Column) -> Column:
    """NaN as null, so that it fails comparisons."""
    return F.when(~F.isnan(x), x)


def shrunk_covariance(s: Column, map_distance: Column, theta: float, m: int, ne: float, cutoff: float, diagonal: Column) -> Column:
    """Off-diagonal covariances shrunk by (1 - theta)^2 and the decay with map distance in cM
    (0 below the cutoff); diagonal ones get the mutation term as well."""
    decay = F.exp(-map_distance * (4 * ne / 100) / (2 * m))
    kept = F.when(decay >= cutoff, decay).otherwise(0.0)
    half = 0.5 * theta * (1 - 0.5 * theta)
    return F.when(diagonal, (1 - theta) ** 2 * s + half).otherwise((1 - theta) ** 2 * s * kept)


def panel_theta(m: int) -> float:
    """The mutation parameter of a panel of m diploid individuals."""
    h = sum(1 / k for k in range(1, 2 * m))
    return (1 / h) / (2 * m + 1 / h)


def band_width(cutoff: float, m: int, ne: float) -> float:
    """Map distance in cM at which the decay reaches the cutoff."""
    import math

    return -math.log(cutoff) * 2 * m * 100 / (4 * ne)
