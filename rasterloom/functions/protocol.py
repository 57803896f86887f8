"""Names, sizes and texts of the interactive delivery protocol, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a request.
REQUEST_FIELDS = ("target", "tid", "fsiz", "roff", "rsiz", "comps", "layers", "len", "type", "model")


def precinct_id(sequence: Column, component: Column, tile: Column, components: Column, tiles: Column) -> Column:
    """Number of a precinct's bin; a component or tile that the image lacks is an error."""
    inside = (sequence >= 0) & component.between(0, components - 1) & tile.between(0, tiles - 1)
    return F.when(inside, (sequence * components + component) * tiles + tile).otherwise(F.raise_error(F.lit("no such tile component")).cast("long"))


def bin_class(wire_class: Column, bin_id: Column) -> Column:
    """Class of a bin; null if it is not supported."""
    return F.when(wire_class.isin(0, 1), 0).when(wire_class.isin(2, 8), wire_class).when((wire_class == 6) & (bin_id == 0), 6).cast("int")


def vbas_size(v: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(v < F.lit(1 << (7 * k)), k).otherwise(out)
    return out.cast("int")


def vbas_bytes(v: Column) -> Column:
    """The groups themselves, as upper-case hex: all but the last have the top bit."""
    n = vbas_size(v)
    groups = F.transform(F.sequence(n - 1, F.lit(0)), lambda k: F.pmod(F.floor(v / F.pow(F.lit(128.0), k)), F.lit(128)) + F.when(k > 0, 128).otherwise(0))
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(g.cast("long")), 2, "0")), "")


def percent_encode(text: Column) -> Column:
    """All bytes but letters, digits and -._~ as %HH."""
    data = F.hex(F.encode(text, "UTF-8"))
    pairs = F.regexp_extract_all(data, F.lit("(..)"), F.lit(1))
    plain = F.transform(
        pairs, lambda h: F.when(F.chr(F.conv(h, 16, 10).cast("long")).rlike("^[A-Za-z0-9._~-]$") & (h < "80"), F.chr(F.conv(h, 16, 10).cast("long"))).otherwise(F.concat(F.lit("%"), h))
    )
    return F.array_join(plain, "")


def percent_decode(text: Column) -> Column:
    """Null where the text has a plus sign or a percent sign without two hex digits."""
    bad = text.contains("+") | text.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~bad, F.try_url_decode(text))


def parse_model(model: Column) -> Column:
    """Array of (class, id, prefix) of a cache model text; prefix null means complete, class null unsupported."""

    def item(s: Column) -> Column:
        name, amount = F.split(s, ":")[0], F.get(F.split(s, ":"), 1)
        kind = F.substring(name, 1, 1)
        number = F.expr("1") * F.when(F.substring(name, F.lit(2), F.length(name)).rlike("^[0-9]+$"), F.substring(name, F.lit(2), F.length(name)))
        cls = F.when(name == "Hm", 6).when((kind == "H") & number.isNotNull(), 2).when((kind == "P") & number.isNotNull(), 0).when((kind == "M") & number.isNotNull(), 8)
        return F.struct(cls.cast("int").alias("class"), F.when(name == "Hm", F.lit(0)).otherwise(number).cast("long").alias("id"), amount.cast("long").alias("prefix"))

    return F.when(model == "", F.array().cast("array<struct<class:int,id:bigint,prefix:bigint>>")).otherwise(F.transform(F.split(model, ","), item))


def format_model_item(cls: Column, bin_id: Column, prefix: Column) -> Column:
    name = F.when(cls == 6, F.lit("Hm")).when(cls == 2, F.concat(F.lit("H"), bin_id)).when(cls == 0, F.concat(F.lit("P"), bin_id)).when(cls == 8, F.concat(F.lit("M"), bin_id))
    return F.concat(name, F.when(prefix.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), prefix)))


def request_fields(query: Column) -> Column:
    """Map of the fields of a request; null where a field is unknown, repeated or malformed."""
    parts = F.split(query, "&")
    names = F.transform(parts, lambda p: F.split(p, "=")[0])
    whole = F.forall(parts, lambda p: p.contains("="))
    known = F.forall(names, lambda n: n.isin(*REQUEST_FIELDS))
    once = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(whole & known & once, F.str_to_map(query, F.lit("&"), F.lit("=")))


def fourcc_text(code: Column) -> Column:
    return F.regexp_replace(code, "[^!-~]", ".")


def model_applies(tid: Column, actual: Column) -> Column:
    return (tid != "0") & (actual != "0") & (tid == actual)
