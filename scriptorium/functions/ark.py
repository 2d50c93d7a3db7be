"""Archival resource keys and service addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"[^@:/#\[\]?]+"
_SHORT = rf"^ark:/({_PART})/({_PART})(?:/({_PART}))?$"
_LONG = rf"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)/ark:/({_PART})/({_PART})(?:/({_PART}))?$"


def parse_ark(text: Column) -> Column:
    """Struct of scheme, authority, naan, name, qualifier and error (null if it parses)."""
    short, long = text.rlike(_SHORT), text.rlike(_LONG)
    part = lambda i, j: F.nullif(F.when(short, F.regexp_extract(text, _SHORT, i)).when(long, F.regexp_extract(text, _LONG, j)), F.lit(""))
    return F.struct(
        F.when(short, "ark").when(long, F.regexp_extract(text, _LONG, 1)).alias("scheme"),
        F.when(long & ~short, F.regexp_extract(text, _LONG, 2)).alias("authority"),
        part(1, 3).alias("naan"),
        part(2, 4).alias("name"),
        part(3, 5).alias("qualifier"),
        F.when(text.isNull() | ~(short | long), F.concat(F.lit("not an ark: "), F.coalesce(text, F.lit("null")))).alias("error"),
    )


def ark_id(ark: Column) -> Column:
    """'ark:/naan/name[/qualifier]'."""
    return F.concat(F.lit("ark:/"), ark["naan"], F.lit("/"), ark["name"], F.when(ark["qualifier"].isNotNull(), F.concat(F.lit("/"), ark["qualifier"])).otherwise(""))


def ark_root(ark: Column) -> Column:
    """The id without qualifier."""
    return F.concat(F.lit("ark:/"), ark["naan"], F.lit("/"), ark["name"])


def is_ark_id(ark: Column) -> Column:
    return (ark["scheme"] == "ark") & ark["authority"].isNull()


def ark_text(ark: Column) -> Column:
    """The whole key, with scheme and authority where it has them."""
    return F.when(is_ark_id(ark), ark_id(ark)).otherwise(F.concat(ark["scheme"], F.lit("://"), ark["authority"], F.lit("/"), ark_id(ark)))


def build_url(base: Column, params: dict[str, Column]) -> Column:
    """base?k=v&..., values quoted with '+' for a space; null values are left out."""
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()])
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def service_url(ark: Column, service: str, params: dict[str, Column]) -> Column:
    """Address of a service that belongs to a key."""
    return build_url(F.concat(ark_text(ark), F.lit(f".{service}")), params)


def make_ark(naan: Column, name: Column, qualifier: Column | None = None, scheme: Column | None = None, authority: Column | None = None) -> Column:
    """The struct of parse_ark from its parts, with an error for a part that is missing or has signs no part may have."""
    none = F.lit(None).cast("string")
    scheme, qualifier, authority = scheme if scheme is not None else F.lit("ark"), qualifier if qualifier is not None else none, authority if authority is not None else none
    bad = lambda part: ~F.coalesce(part.rlike(f"^{_PART}$"), F.lit(False))
    error = (
        F.when(bad(naan), "bad naan").when(bad(name), "bad name").when(qualifier.isNotNull() & bad(qualifier), "bad qualifier")
        .when(bad(scheme), "bad scheme").when((scheme != "ark") & authority.isNull(), "a scheme needs an authority").when((scheme == "ark") & authority.isNotNull(), "an ark has no authority")
    )
    return F.struct(scheme.alias("scheme"), authority.alias("authority"), naan.alias("naan"), name.alias("name"), qualifier.alias("qualifier"), error.alias("error"))


def ark_with(ark: Column, **parts: Column) -> Column:
    """A copy with other parts, checked again."""
    return make_ark(**{k: parts.get(k, ark[k]) for k in ("naan", "name", "qualifier", "scheme", "authority")})
