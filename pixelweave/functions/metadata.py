"""Metadata as columns: Exif maps, XMP and colour profile structs, custom fields as variants, animation frames.

A value that was not set is null; a getter that meets another kind of value gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import clamp

EXIF_VALUE = "struct<kind:string,s:string,i:decimal(20,0),f:double,num:bigint,den:bigint,b:binary>"
EXIF = f"map<string,{EXIF_VALUE}>"
XMP = "struct<title:string,description:string,creator:array<string>,subject:array<string>,rights:string,rating:int,label:string,marked:boolean,create_date:string,modify_date:string,creator_tool:string,custom:map<string,string>>"
FRAME = "struct<delay_ms:bigint,x_offset:bigint,y_offset:bigint,width:bigint,height:bigint,blend_mode:string,dispose_mode:string,is_keyframe:boolean,data:binary>"
#: Field of each kind of Exif value.
KINDS = {"string": "s", "int": "i", "uint": "i", "float": "f", "bytes": "b"}
#: Tag and kind behind each keyword of exif().
SETTERS = {"make": ("Make", "string"), "model": ("Model", "string"), "software": ("Software", "string"), "date_time": ("DateTime", "string"), "iso": ("ISOSpeedRatings", "int"), "focal_length": ("FocalLength", "float"), "aperture": ("FNumber", "float"),
           "exposure": ("ExposureTime", "float"), "latitude": ("GPSLatitude", "float"), "longitude": ("GPSLongitude", "float"), "artist": ("Artist", "string"), "copyright": ("Copyright", "string"), "description": ("ImageDescription", "string"), "orientation": ("Orientation", "int")}


def _struct(layout: str, **values) -> Column:
    """A struct of a layout; fields without a value are null."""
    fields = dict(f.split(":", 1) for f in _split(layout))
    unknown = set(values) - set(fields)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[lit(values.get(n)).cast(t).alias(n) for n, t in fields.items()])


def _split(layout: str) -> list[str]:
    out, depth = [""], 0
    for c in layout[len("struct<") : -1]:
        depth += (c in "<(") - (c in ">)")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("{}"), kind)


# Exif.


def exif_value(kind: str, value, den=None) -> Column:
    """A tag's value; rational and srational take a numerator and a denominator. A null value gives null."""
    value = value if isinstance(value, Column) else F.lit(value)
    fields = {"num": value, "den": den} if kind in ("rational", "srational") else {KINDS[kind]: value}
    return F.when(value.isNotNull(), _struct(EXIF_VALUE, kind=kind, **fields))


def exif(**values) -> Column:
    """An Exif map from the keywords of SETTERS; null values set nothing."""
    pairs = [(F.lit(tag), exif_value(kind, v)) for n, v in values.items() for tag, kind in [SETTERS[n]]]
    made = F.map_from_arrays(F.array(*[p[0] for p in pairs]), F.array(*[p[1] for p in pairs])) if pairs else _empty(EXIF)
    return F.map_filter(made, lambda _, v: v.isNotNull())


def set_tag(data: Column, tag: str, value: Column) -> Column:
    if tag not in fixed.EXIF_TAGS:
        raise ValueError(f"no such tag: {tag}")
    return F.map_concat(F.map_filter(F.coalesce(data, _empty(EXIF)), lambda k, _: k != tag), F.create_map(F.lit(tag), value))


def get_tag(data: Column, tag: str) -> Column:
    return F.try_element_at(data, F.lit(tag))


def as_string(v: Column) -> Column:
    return F.when(v["kind"] == "string", v["s"])


def as_int(v: Column) -> Column:
    """Signed and unsigned integers, the latter in two's complement."""
    top = F.lit(str(2**63)).cast("decimal(20,0)")
    wrapped = F.when(v["i"] >= top, v["i"] - top - top).otherwise(v["i"])
    return F.when(v["kind"].isin("int", "uint"), wrapped.cast("bigint"))


def as_float(v: Column) -> Column:
    return F.when(v["kind"] == "float", v["f"]).when(v["kind"].isin("rational", "srational"), F.try_divide(v["num"], v["den"]))


def camera(data: Column) -> dict[str, Column]:
    """The named readings of an Exif map; gps needs both coordinates."""
    read = {"string": as_string, "int": as_int, "float": as_float}
    names = {"make": "camera_make", "model": "camera_model", "exposure": "exposure_time"}
    out = {names.get(n, n): read[SETTERS[n][1]](get_tag(data, SETTERS[n][0])) for n in ("make", "model", "date_time", "iso", "focal_length", "aperture", "exposure", "orientation")}
    lat, lon = (as_float(get_tag(data, t)) for t in ("GPSLatitude", "GPSLongitude"))
    return out | {"gps_coordinates": F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))}


# XMP.


def xmp(**values) -> Column:
    """An XMP struct. creator, subject and custom are empty if not given; the rating is kept to 0..5."""
    values = {"creator": _empty_array(), "subject": _empty_array(), "custom": _empty("map<string,string>")} | values
    return xmp_set(_struct(XMP, **values), "rating", values["rating"]) if "rating" in values else _struct(XMP, **values)


def _empty_array() -> Column:
    return F.array().cast("array<string>")


def xmp_set(data: Column, field: str, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return data.withField(field, F.when(value.isNotNull(), clamp(value.cast("int"), 0, 5)) if field == "rating" else value)


def xmp_add(data: Column, field: str, value) -> Column:
    """Appends to creator or subject."""
    return data.withField(field, F.array_append(data[field], value))


def set_custom(data: Column, key: str, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return data.withField("custom", F.map_concat(F.map_filter(data["custom"], lambda k, _: k != key), F.create_map(F.lit(key), value)))


def get_custom(data: Column, key: str) -> Column:
    return F.try_element_at(data["custom"], F.lit(key))


# Colour profiles.


def icc(name: str, raw: Column | None = None) -> Column:
    """A profile of fixed.ICC; raw: the embedded profile's bytes."""
    _, space, intent, title, about = next(p for p in fixed.ICC if p[0] == name)
    values = {"color_space": space, "rendering_intent": intent, "profile_name": title, "description": about}
    return F.struct(*[F.lit(v).alias(n) for n, v in values.items()], (F.lit(None) if raw is None else raw).cast("binary").alias("raw_data"))


# Custom fields: a map of variants.

_TYPES = {"string": ("bigint", r"^STRING$"), "int": ("bigint", r"^BIGINT$"), "float": ("double", r"^(DOUBLE|FLOAT|DECIMAL.*)$"), "bool": ("boolean", r"^BOOLEAN$")}


def custom_fields(json: Column) -> Column:
    """A JSON object's fields."""
    return F.from_json(json, "map<string,variant>")


def get_typed(fields: Column, key: str, kind: str) -> Column:
    """A field as string, int, float or bool, if it is of that kind; integers are not floats."""
    v = F.try_element_at(fields, F.lit(key))
    sql, pattern = ("string" if kind == "string" else _TYPES[kind][0]), _TYPES[kind][1]
    return F.when(F.regexp_like(F.schema_of_variant(v), F.lit(pattern)), F.try_variant_get(v, "$", sql))


def set_field(fields: Column, key: str, value: Column) -> Column:
    return F.map_concat(remove_field(fields, key), F.create_map(F.lit(key), value))


def remove_field(fields: Column, key: str) -> Column:
    return F.map_filter(fields, lambda k, _: k != key)


# Animation.


def frame(width, height, data, **values) -> Column:
    """A frame of 100 ms at (0, 0), a keyframe, blended as Source and disposed of as None, unless said otherwise. The modes are stored, not applied."""
    start = {"delay_ms": 100, "x_offset": 0, "y_offset": 0, "blend_mode": "Source", "dispose_mode": "None", "is_keyframe": True}
    return _struct(FRAME, **(start | values | {"width": width, "height": height, "data": data}))


def animation(frames: Column | None = None, loop_count: int = 0, background: bytes = bytes(4)) -> Column:
    """A loop count of 0 never ends."""
    frames = F.array().cast(f"array<{FRAME}>") if frames is None else frames
    return F.struct(F.lit(loop_count).cast("bigint").alias("loop_count"), F.lit(bytearray(background)).alias("background_color"), frames.alias("frames"))


def add_frame(data: Column, new: Column, keyframe: bool | None = None) -> Column:
    """Appends a frame, as a keyframe or a delta frame if keyframe says so."""
    new = new if keyframe is None else new.withField("is_keyframe", F.lit(keyframe))
    return data.withField("frames", F.array_append(data["frames"], new))
