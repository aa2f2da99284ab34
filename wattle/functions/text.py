"""Address text columns (A1-A13, A20) and search predicates.

PostgreSQL's ``CONCAT`` treats null as '' while Spark's ``concat`` returns null,
so every concatenation here is ``concat_ws`` (which skips nulls and keeps '',
like PostgreSQL's ``CONCAT_WS``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _s(c) -> Column:
    return _c(c).cast("string")


def cat(*parts) -> Column:
    """Null-as-empty concatenation (PostgreSQL ``CONCAT``)."""
    return F.concat_ws("", *[_s(p) for p in parts])


def nullif_blank(c) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


# ----------------------------------------------------------------------------- A1 / A2
def unit_part(flat_type_name, flat_number) -> Column:
    return F.concat_ws(" ", _s(flat_type_name), _s(flat_number))


def street_number_part(number_first, number_last) -> Column:
    """``first[ -last]`` as in the component query."""
    return F.concat_ws(" ", _s(number_first), F.when(_c(number_last).isNotNull(), cat(F.lit("-"), number_last)))


def street_part(street_name, street_type_name, street_suffix_name=None) -> Column:
    parts = [_s(street_name), _s(street_type_name)]
    if street_suffix_name is not None:
        parts.append(_s(street_suffix_name))
    return F.concat_ws(" ", *parts)


def full_address(flat_type_name, flat_number, level_type_name, level_number, number_first, number_last,
                 street_name, street_type_name, street_suffix_name, locality_name, state_abbreviation,
                 postcode) -> Column:
    """A2: ``unit, level, number street type suffix, locality, STATE postcode``."""
    return F.concat_ws(
        ", ",
        nullif_blank(F.concat_ws(" ", _s(flat_type_name), _s(flat_number))),
        nullif_blank(F.concat_ws(" ", _s(level_type_name), _s(level_number))),
        F.trim(F.concat_ws(" ", _s(number_first),
                           F.when(_c(number_last).isNotNull(), cat(F.lit("-"), number_last)),
                           _s(street_name), _s(street_type_name), _s(street_suffix_name))),
        _s(locality_name),
        cat(state_abbreviation, F.lit(" "), postcode),
    )


def plain_address(flat_number, number_first, street_name, street_type_name=None, *area) -> Column:
    """A3: ``[Unit n,] number street [type] [locality STATE postcode]``; parts that are null are left out.

    The four shapes: without type (``simple_address``), street line alone (no ``area``), and with type and area, which
    the postcode and the geocode listings share.
    """
    parts = [number_first, street_name, *([] if street_type_name is None else [street_type_name]), *area]
    return F.concat_ws(" ", F.when(_c(flat_number).isNotNull(), cat(F.lit("Unit "), flat_number, F.lit(","))), *[_s(p) for p in parts])


def simple_address(flat_number, number_first, street_name, locality_name, state_abbreviation, postcode) -> Column:
    """A3: ``[Unit n,] number street locality STATE postcode``."""
    return plain_address(flat_number, number_first, street_name, None, locality_name, state_abbreviation, postcode)


def search_address(number_first_prefix, number_first, number_first_suffix, street_name, street_type_name,
                   locality_name, state_abbreviation, postcode) -> Column:
    """A4: the radius page's ``||`` chain with COALESCE defaults."""
    def co(x, suffix, default):
        return F.coalesce(F.concat(_s(x), F.lit(suffix)), F.lit(default))
    return F.concat(co(number_first_prefix, "", ""), co(number_first, "", ""), co(number_first_suffix, " ", " "),
                    co(street_name, " ", ""), co(street_type_name, ", ", ", "), co(locality_name, " ", " "),
                    co(state_abbreviation, " ", " "), co(postcode, "", ""))


def street_number_label(flat_type_name, flat_number, number_first, number_first_suffix,
                        number_last, number_last_suffix) -> Column:
    """``flat type, flat, first+suffix, -last+suffix`` (search result column)."""
    return F.concat_ws(" ", _s(flat_type_name), _s(flat_number), cat(number_first, F.coalesce(_s(number_first_suffix), F.lit(""))),
                       F.when(_c(number_last).isNotNull(),
                              cat(F.lit("-"), number_last, F.coalesce(_s(number_last_suffix), F.lit("")))))


# ----------------------------------------------------------------------------- A8 / A10-A13
def display_number(number_first, number_first_suffix, number_last, number_last_suffix) -> Column:
    """``first[suf]-last[suf]`` when a last number exists, else ``first`` or N/A."""
    fs = F.coalesce(nullif_empty(_s(number_first_suffix)), F.lit(""))
    ls = F.coalesce(nullif_empty(_s(number_last_suffix)), F.lit(""))
    return F.when(_c(number_last).isNotNull() & (_c(number_last) != 0),
                  F.concat(_s(number_first), fs, F.lit("-"), _s(number_last), ls)) \
            .otherwise(F.concat(F.coalesce(nullif_empty(_s(number_first)), F.lit("N/A")), fs))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_unit(flat_type_name, flat_number) -> Column:
    """``type n`` / ``n`` / '-'."""
    has = _c(flat_number).isNotNull() & (_c(flat_number) != 0)
    return F.when(has & nullif_empty(_s(flat_type_name)).isNotNull(),
                  F.concat(_s(flat_type_name), F.lit(" "), _s(flat_number))) \
            .when(has, _s(flat_number)).otherwise(F.lit("-"))


def display_coords(lat, lon) -> Column:
    """``lat, lon`` with six decimals, 'N/A' when either is missing or zero."""
    ok = _c(lat).isNotNull() & _c(lon).isNotNull() & (_c(lat) != 0) & (_c(lon) != 0)
    return F.when(ok, F.format_string("%.6f, %.6f", _c(lat).cast("double"), _c(lon).cast("double"))) \
            .otherwise(F.lit("N/A"))


def map_link(lat, lon) -> Column:
    """Map link with a pin at the point ('' without coordinates)."""
    ok = _c(lat).isNotNull() & _c(lon).isNotNull() & (_c(lat) != 0) & (_c(lon) != 0)
    # Fixed value: link template.
    return F.when(ok, F.format_string("https://www.google.com/maps?q=%.6f,%.6f",
                                      _c(lat).cast("double"), _c(lon).cast("double"))).otherwise(F.lit(""))


def slug(c) -> Column:
    """Lower case, whitespace runs -> '-', drop everything but [a-z0-9-]."""
    return F.regexp_replace(F.regexp_replace(F.lower(_s(c)), r"\s+", "-"), r"[^a-z0-9-]", "")


# Street-type spellings used by the two property sites (A10).
# Abbreviated form (RealEstate):
STREET_TYPE_ABBREVIATED = {
    "avenue": "ave", "av": "ave", "ave": "ave",
    "street": "st", "st": "st",
    "road": "rd", "rd": "rd",
    "drive": "dr", "dr": "dr",
    "court": "ct", "ct": "ct",
    "place": "pl", "pl": "pl",
    "crescent": "cres", "cres": "cres", "cr": "cres",
    "lane": "ln", "ln": "ln",
    "terrace": "tce", "tce": "tce",
    "parade": "pde", "pde": "pde",
    "way": "way",
    "highway": "hwy", "hwy": "hwy",
    "esplanade": "esp", "espl": "esp", "esp": "esp",
}
# Full form (Domain):
STREET_TYPE_FULL = {
    "av": "avenue", "ave": "avenue", "avenue": "avenue",
    "st": "street", "street": "street",
    "rd": "road", "road": "road",
    "dr": "drive", "drive": "drive",
    "ct": "court", "court": "court",
    "pl": "place", "place": "place",
    "cr": "crescent", "cres": "crescent", "crescent": "crescent",
    "ln": "lane", "lane": "lane",
    "tce": "terrace", "terrace": "terrace",
    "pde": "parade", "parade": "parade",
    "way": "way",
    "hwy": "highway", "highway": "highway",
    "espl": "esplanade", "esp": "esplanade", "esplanade": "esplanade",
    "gr": "grove", "grove": "grove",
    "cir": "circuit", "circuit": "circuit",
    "cl": "close", "close": "close",
}


def _dict_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def street_type_for_site(street_type, full: bool) -> Column:
    """A10: dictionary lookup of the lower-cased type, falling back to the lower-cased type."""
    low = F.lower(_s(street_type))
    m = _dict_map(STREET_TYPE_FULL if full else STREET_TYPE_ABBREVIATED)
    return F.when(nullif_empty(_s(street_type)).isNotNull(), F.coalesce(F.element_at(m, low), low)).otherwise(F.lit(""))


def property_links(flat_number, number_first, number_first_suffix, number_last, number_last_suffix,
                   street_name, street_type, suburb, state, postcode) -> tuple[Column, Column]:
    """The two property-site links; '' unless number, street, suburb, state and postcode all exist."""
    num = F.trim(F.replace(display_number(number_first, number_first_suffix, number_last, number_last_suffix),
                           F.lit("N/A"), F.lit("")))
    unit = F.when(_c(flat_number).isNotNull() & (_c(flat_number) != 0), _s(flat_number)).otherwise(F.lit(""))

    def street(full):
        t = street_type_for_site(street_type, full)
        return slug(F.concat_ws(" ", nullif_empty(_s(street_name)), nullif_empty(t)))

    sub = slug(F.coalesce(_s(suburb), F.lit("")))
    st = F.lower(F.coalesce(_s(state), F.lit("")))
    pc = F.coalesce(_s(postcode), F.lit(""))

    def link(full, prefix, unit_prefix, tail):
        s = street(full)
        ok = (num != "") & (s != "") & (sub != "") & (st != "") & (pc != "")
        body = F.concat_ws("-", num, s, sub, st, pc)
        return F.when(ok & (unit != ""), F.concat(F.lit(prefix), F.lit(unit_prefix), unit, F.lit("-"), body, F.lit(tail))) \
                .when(ok, F.concat(F.lit(prefix), body, F.lit(tail))).otherwise(F.lit(""))

    # Link templates of the two sites.
    real_estate = link(False, "https://www.realestate.com.au/property/", "unit-", "/")
    domain = link(True, "https://www.domain.com.au/property-profile/", "", "")
    return real_estate, domain


# ----------------------------------------------------------------------------- A9
# Geocode type codes and their labels.
GEOCODE_TYPE_LABELS = {
    "PC": "Property Centroid", "BC": "Building Centroid", "FC": "Frontage Centre", "FP": "Frontage Point",
    "SC": "Street Locality Centroid", "SL": "Street Locality", "LC": "Locality Centroid", "L": "Locality",
    "UC": "Unit Centroid", "EM": "Emergency Management", "PAR": "Parcel", "STL": "Street Locality",
    "GAP": "Gap Geocode",
}
# Numeric confidence -> label.
CONFIDENCE_LABELS = {3: "Very High", 2: "High", 1: "Medium", 0: "Low", -1: "None"}


def geocode_type_label(code) -> Column:
    return F.coalesce(F.element_at(_dict_map(GEOCODE_TYPE_LABELS), _s(code)), F.lit("N/A"))


def confidence_label(conf) -> Column:
    return F.coalesce(F.element_at(_dict_map(CONFIDENCE_LABELS), _c(conf).cast("int")), F.lit("Unknown"))


# ----------------------------------------------------------------------------- F3 / F5 / A20
def escape_like(text: str) -> str:
    """Escape LIKE wildcards of user text (the reference passes them through live)."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def icontains(c, text: str, escape: bool = True) -> Column:
    """case-insensitive substring test."""
    t = escape_like(text) if escape else text
    return F.upper(_s(c)).like(f"%{t.upper()}%")


def istarts(c, text: str, escape: bool = True) -> Column:
    """case-insensitive prefix test."""
    t = escape_like(text) if escape else text
    return F.upper(_s(c)).like(f"{t.upper()}%")


def number_contains(c, text: str) -> Column:
    """``CAST(number AS TEXT) LIKE %text%``."""
    return _s(c).contains(text)


def is_coordinate_like(c) -> Column:
    """Numeric text containing '.' with |value| <= 180 (e.g. '151.21' as a street name)."""
    v = F.trim(_s(c)).try_cast("double")
    return v.isNotNull() & _s(c).contains(".") & (F.abs(v) <= 180)


def lot_address(c: dict) -> Column:
    """A5: the catchment page's 17-part ``||`` chain (lot, flat, level, number, street).

    ``c`` maps part names to columns (absent parts are null).  As in the
    reference, the '-' before the last number appears only with a last-number
    prefix, so ``number_last`` otherwise follows the first number directly.
    """
    def g(name):
        v = c.get(name)
        return _s(v) if v is not None else F.lit(None).cast("string")

    def co(x, suffix):
        return F.coalesce(F.concat(x, F.lit(suffix)), F.lit(""))

    return F.concat(
        co(g("lot_number_prefix"), " "), co(g("lot_number"), " "), co(g("lot_number_suffix"), " "),
        co(g("flat_type"), " "), co(g("flat_number_prefix"), ""), co(g("flat_number"), ""),
        co(g("flat_number_suffix"), " "), co(g("level_type_code"), " "), co(g("level_number_prefix"), ""),
        co(g("level_number"), ""), co(g("level_number_suffix"), " "), co(g("number_first_prefix"), ""),
        co(g("number_first"), ""), co(g("number_first_suffix"), ""),
        F.coalesce(F.concat(F.lit("-"), g("number_last_prefix"), F.lit("")), F.lit("")),
        co(g("number_last"), ""), co(g("number_last_suffix"), " "), co(g("street_name"), " "),
        co(g("street_type"), " "),
    )


# The school page's descriptions of geocode types and of confidence words (A9, second set).
GEOCODE_DETAIL = {
    "BAP": "Building Access Point - Point of access to the building",
    "BC": "Building Centroid - Centre of building footprint",
    "BCP": "Building Centroid Point - Centre of building",
    "CDF": "Cadastral Frontage - Property boundary on street",
    "EC": "Emergency Access - Emergency service access point",
    "ECP": "Emergency Centroid Point - Emergency centroid",
    "FC": "Frontage Centre - Centre of property frontage",
    "FCP": "Frontage Centre Point - Centre point of frontage",
    "GAP": "Gazetted Address Point - Official gazetted location",
    "LCP": "Locality Centre Point - Centre of locality",
    "PAP": "Property Access Point - Main property access",
    "PC": "Property Centroid - Centre of property",
    "UC": "Unit Centroid - Centre of unit",
}
CONFIDENCE_DETAIL = {
    "HIGH": "High confidence in coordinate accuracy",
    "MEDIUM": "Medium confidence in coordinate accuracy",
    "LOW": "Low confidence in coordinate accuracy",
    "VERY LOW": "Very low confidence in coordinate accuracy",
    "UNKNOWN": "Confidence level unknown",
}


def _described(c, words: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(_dict_map(words), _s(c)), F.lit(other))


def geocode_detail(code) -> Column:
    """The school page's description of a geocode type."""
    return _described(code, GEOCODE_DETAIL, "Unknown geocode type")


def confidence_detail(word) -> Column:
    """The school page's description of a confidence word."""
    return _described(word, CONFIDENCE_DETAIL, "Unknown confidence level")
