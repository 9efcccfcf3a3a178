"""VCF record fields as column expressions over calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_label(qual: Column) -> Column:
    return F.when(qual.isNull() | (qual >= 5.0), "PASS").otherwise("q5")


def end_position(sv_type: Column, pos: Column, sv_len: Column) -> Column:
    return F.when(sv_type == "INS", pos + 1).otherwise(pos + 1 + F.abs(sv_len))


def info(c: dict[str, Column], report_readid: bool) -> Column:
    """The INFO column, per type."""
    t = c["sv_type"]
    names = F.array_join(c["read_ids"], ",") if report_readid else F.lit("NULL")
    strand = F.when(t == "DUP", "-+").when(t == "INV", c["orient"])
    precise = F.when(c["gt"] == "0/0", "IMPRECISE").otherwise("PRECISE")

    def pair(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}="), value.cast("string"))

    return F.concat_ws(
        ";",
        precise,
        pair("SVTYPE", t),
        F.when(t != "BND", pair("SVLEN", c["sv_len"])),
        F.when(t != "BND", pair("END", end_position(t, c["pos"], c["sv_len"]))),
        F.when(t.isin("DEL", "INS"), pair("CIPOS", c["cipos"])),
        F.when(t.isin("DEL", "INS"), pair("CILEN", c["cilen"])),
        pair("RE", c["support"]),
        F.when(strand.isNotNull(), pair("STRAND", strand)),
        pair("RNAMES", names),
        F.when(t == "DEL", pair("STRAND", F.lit("+-"))),
    )


def dot(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("."))


def sample_column(c: dict[str, Column]) -> Column:
    return F.concat_ws(":", c["gt"], dot(c["dr"]), c["support"].cast("string"), c["pl"], dot(c["gq"]))
