"""Functions on the fields of a record: typed tags, flags, record structs, template counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alignment flag bits and the bits that the first columnar version gives them.
FLAG_BITS = {1: 256, 2: 128, 4: 64, 16: 32, 64: 16, 128: 8, 256: 4, 512: 2, 1024: 1}
#: Trace formats and their codes in the order of the format list.
TRACE_TYPES = ("UNK", "SCF", "ABI", "ALF", "PLN", "EXP", "CTF", "ZTR", "ZTR1", "ZTR2", "ZTR3", "BIO", "SFF", "ANYTR")


def _typed(tags: Column, name: str, types: str) -> Column:
    found = F.element_at(tags, F.lit(name))
    return F.when(found["type"].isin(*types), found["value"])


def tag_int(tags: Column, name: str) -> Column:
    """The tag as a long, null if it is absent or of another type."""
    return _typed(tags, name, "cCsSiI").cast("long")


def tag_float(tags: Column, name: str) -> Column:
    return _typed(tags, name, "fd").cast("double")


def tag_char(tags: Column, name: str) -> Column:
    return F.substring(_typed(tags, name, "A"), 1, 1)


def tag_text(tags: Column, name: str) -> Column:
    return _typed(tags, name, "ZH")


def tag_array(tags: Column, name: str) -> Column:
    """Numbers of a B tag, whose value is ``subtype,number,...``."""
    return F.transform(F.slice(F.split(_typed(tags, name, "B"), ","), 2, 2**30), lambda x: x.cast("double"))


def add_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    """``tags`` with one more; a tag of that name is replaced, a null value adds nothing."""
    new = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.when(value.isNull(), tags).otherwise(F.map_concat(F.map_filter(tags, lambda k, _: k != name), new))


def add_tag_array(tags: Column, name: str, subtype: str, values: Column) -> Column:
    text = F.concat_ws(",", F.lit(subtype), F.transform(values, lambda v: v.cast("string")))
    return add_tag(tags, name, "B", F.when(values.isNotNull(), text))


def add_tags_from_text(tags: Column, text: Column) -> Column:
    """``tags`` with those of tab-separated TG:T:value fields, which replace older ones."""
    from basestream.functions.tags import parse

    more = parse(F.filter(F.split(text, "\t"), lambda t: t != ""))
    return F.map_concat(F.map_filter(tags, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)


def tag_entries(tags: Column) -> Column:
    """Tags as an array of (name, type, value), by name."""
    return F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), e["value"]["value"].alias("value"))))


def fill_tag(tags: Column, name: str, kind: str, computed: Column, wanted: Column | bool = True) -> Column:
    """A computed tag (MD, NM) where it is wanted, known, and not stored already."""
    missing = F.lit(wanted) if isinstance(wanted, bool) else wanted
    return add_tag(tags, name, kind, F.when(missing & F.element_at(tags, F.lit(name)).isNull(), computed))


def swap_flags(flag: Column, back: bool = False) -> Column:
    """Alignment flag bits as the first columnar version orders them; ``back`` reverses it.
    Bits without a counterpart go."""
    out = F.lit(0)
    for a, b in FLAG_BITS.items():
        old, new = (b, a) if back else (a, b)
        out = out + F.when(flag.bitwiseAND(old) != 0, new).otherwise(0)
    return out


def record(**fields: Column) -> Column:
    """A record struct; what isn't given takes its empty value."""
    from basestream.model import ALIGNMENTS

    empty = {"string": F.lit("*"), "int": F.lit(0), "bigint": F.lit(0)}
    made = []
    for f in ALIGNMENTS.fields:
        kind = f.dataType.simpleString()
        value = fields.get(f.name, F.array().cast(kind) if kind.startswith("array") else F.lit(-1) if f.name.endswith("ref_id") or f.name in ("pos", "pnext") else empty[kind])
        made.append(value.cast(kind).alias(f.name))
    return F.struct(*made)


def copy_record(rec: Column, **fields: Column) -> Column:
    """A record with some fields changed."""
    out = rec
    for name, value in fields.items():
        out = out.withField(name, value)
    return out


def expected_templates(flag: Column, tags: Column) -> Column:
    """Records that a template should have: two if paired, else one; a TC tag raises that;
    split alignments (SA) without TC leave it open, as the greatest int."""
    count = F.when(flag.bitwiseAND(1) != 0, 2).otherwise(1).cast("long")
    tc = tag_int(tags, "TC")
    return F.when(tc.isNotNull(), F.greatest(count, tc)).when(F.element_at(tags, F.lit("SA")).isNotNull(), F.lit(2**31 - 1)).otherwise(count).cast("long")


def fastq_bases(seq: Column, character_set: Column) -> Column:
    """Dots are N, unless the character set is "0", where they are kept."""
    return F.when(F.coalesce(character_set, F.lit("")) == "0", seq).otherwise(F.translate(seq, ".", "N"))


def fastq_confidence(seq: Column, confidence: Column) -> Column:
    """Confidence of called bases; of what isn't A, C, G or T it is 0."""
    return F.zip_with(F.split(F.upper(seq), ""), confidence, lambda b, q: F.when(b.isin(*"ACGT"), q).otherwise(0))


def accuracy_string(confidence: Column) -> Column:
    """Confidence values as text of the accuracy line: numbers parted by blanks."""
    return F.array_join(F.transform(confidence, lambda x: x.cast("string")), " ")


def accuracy_values(text: Column) -> Column:
    """The inverse; text in 4-tuples (with commas) has no values."""
    some = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(~text.contains(","), F.transform(some, lambda x: x.cast("long")))


def trace_code(name: Column) -> Column:
    """Number of a trace format's name, in upper or lower case; unknown names are 0."""
    out = F.lit(0)
    for k, t in enumerate(TRACE_TYPES):
        out = F.when(name.isin(t, t.lower()), k).otherwise(out)
    return out


def trace_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in TRACE_TYPES]), code.cast("int")), F.lit("UNK"))


def vector_clip(left: Column, right: Column, vector_left: Column, vector_right: Column) -> tuple[Column, Column]:
    """Cutoffs (both exclusive) after a vector range is taken out: a range before the kept
    part changes nothing, one over its beginning moves the left cutoff, one over all of it
    empties it, and one inside or over its end moves the right cutoff."""
    over_start = vector_left <= left + 1
    before = (vector_left <= left) & (vector_right <= left)
    new_left = F.when(~before & over_start & (vector_right < right), vector_right).otherwise(left)
    new_right = F.when(before, right).when(over_start & (vector_right >= right), left + 1).when(~over_start & (vector_left < right), vector_left).otherwise(right)
    return new_left, new_right


def tcl_hash(text: Column) -> Column:
    """The 32-bit hash h * 9 + byte over the bytes of a name."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.length(hexed) / 2
    places = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: (h * 9 + byte(i)) % F.lit(1 << 32))
