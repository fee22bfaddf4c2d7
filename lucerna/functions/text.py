
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the to what when why with".split()
#: Characters that count as white space.
SPACE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same, one by one.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Text) -> Column:
    return F.btrim(_c(x), F.lit(SPACES))  # a pattern would try each space of a text as the end


def normalize(x: Text) -> Column:
    """without white space at the ends, in lower case."""
    return F.lower(strip(x))


def _decomposed() -> dict[str, str]:
    """Small letters that are an ASCII letter with one mark, by their canonical decomposition, in the Latin blocks."""
    each = {chr(c): unicodedata.normalize("NFD", chr(c)) for block in (range(0x80, 0x250), range(0x1E00, 0x1F00)) for c in block}
    return {c: d[0] for c, d in each.items() if len(d) == 2 and d[0].isascii() and d[0].islower() and unicodedata.combining(d[1])}


#: Combining marks that a full-text index drops; letters with one of them stand for their base.
MARKS = "".join(map(chr, [0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331]))
MARKED = _decomposed() | {"\u017f": "s", "\u1e9b": "s"}


def without_marks(x: Text) -> Column:
    """In lower case, letters with one diacritic as their base letter, combining marks left out; letters with several marks stay."""
    return unmarked(F.lower(_c(x)))


def unmarked(low: Column) -> Column:
    """without_marks of a text in lower case."""
    return F.translate(low, "".join(MARKED) + MARKS, "".join(MARKED.values()))


def collapse(x: Text) -> Column:
    """every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"[{SPACE}]+", " "))  # only spaces are left to be taken off


def tokenize(x: Text) -> Column:
    """words of a-z and 0-9 of two characters or more that aren't stop words, in order, repeats kept."""
    words = F.split(F.regexp_replace(normalize(x), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def unique(x: Text) -> Column:
    """each element once, where it stood first."""
    return F.array_distinct(_c(x))


def excerpt(x: Text, most: int = 180) -> Column:
    """at most that many characters, the last three being dots if something was cut off."""
    x = _c(x)
    cut = F.rtrim(F.substring(x, 1, most - 3), F.lit(SPACES))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("...")))


def slug(x: Text) -> Column:
    """F5."""
    s = F.regexp_replace(F.regexp_replace(normalize(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 48), F.lit("")), F.lit("item"))


def build_id(prefix: str, x: Text, index: Column) -> Column:
    """F6."""
    return F.concat(F.lit(prefix + "_"), slug(x), F.when(index > 0, F.concat(F.lit("_"), index.cast("string"))).otherwise(""))


def scoped_id(session: Text, x: Text) -> Column:
    """F7."""
    return F.concat_ws("_", _c(session), _c(x))


def stable_id(*key: Text) -> Column:
    """F8: the same id for the same natural key, so that a repeated write changes nothing."""
    return F.sha2(F.concat_ws("\x1f", *[_c(k).cast("string") for k in key]), 256)


def display_title(x: Text) -> Column:
    """_ and - as spaces, each word's first letter in upper case, the rest as it is."""
    bare = strip(F.regexp_replace(_c(x), "[_-]+", " "))
    parts = F.regexp_extract_all(bare, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def clock(seconds: Text) -> Column:
    """minutes and seconds, minutes beyond 59 too; negative as 0."""
    s = F.greatest(F.floor(_c(seconds)), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def clock_seconds(x: Text) -> Column:
    """the first [hh:]mm:ss in the text as seconds, else null."""
    part = lambda k: F.regexp_extract(_c(x), r"(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})", k)
    hours = F.coalesce(F.nullif(part(1), F.lit("")).cast("long"), F.lit(0))
    return F.when(part(3) != "", hours * 3600 + F.nullif(part(2), F.lit("")).cast("long") * 60 + F.nullif(part(3), F.lit("")).cast("long"))


def transcript_line(x: Text, position: Column) -> Column:
    """struct speaker, text, started_at of a paragraph '[mm:ss] Name: words', each part but the words optional."""
    stamp = r"^\[?((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2})\]?\s*(.*)\z"
    timed = _c(x).rlike(stamp)
    rest = F.when(timed, strip(F.regexp_extract(_c(x), stamp, 2))).otherwise(_c(x))
    named = rest.rlike(r"^([^:]{2,40}):\s+(.*)\z")
    return F.struct(
        F.when(named, strip(F.regexp_extract(rest, r"^([^:]{2,40}):\s+(.*)\z", 1))).otherwise("Lecture").alias("speaker"),
        F.when(named, strip(F.regexp_extract(rest, r"^([^:]{2,40}):\s+(.*)\z", 2))).otherwise(rest).alias("text"),
        F.coalesce(F.when(timed, clock_seconds(F.regexp_extract(_c(x), stamp, 1))), position * 30).cast("long").alias("started_at"),
    )


def key_value(line: Text) -> Column:
    """struct key (normalised), value of a line split at its first colon; null if either is empty."""
    at = F.instr(_c(line), ":")
    key = normalize(F.substr(_c(line), F.lit(1), F.greatest(at - 1, F.lit(0))))
    value = strip(F.substr(_c(line), at + 1))
    return F.when((at > 0) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def delimited(x: Text) -> Column:
    """parts between ; , and |, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(_c(x), "[;,|]"), strip), lambda p: p != "")


def extension(name: Text) -> Column:
    """F16."""
    return F.lower(F.regexp_extract(strip(name), r"\.([^.]*)$", 1))


def base_name(name: Text) -> Column:
    """F16."""
    return F.lower(F.regexp_replace(strip(name), r"\.[^.]+$", ""))


#: Words of a file's name, in order of precedence, and the kind they mean.
KINDS = [
    ("session", "session|metadata|meta"),
    ("glossary", "glossary|terms|definitions"),
    ("transcript", "transcript|captions|subtitles"),
    ("summaries", "summary|summaries|overview"),
    ("categories", "categories|category"),
    ("public_qa", "publicqa|public_qa|community|qa|q&a|questions"),
]
#: File extensions.
REFUSED = "ppt key doc docx xls xlsx".split()
SUPPORTED = "json txt md markdown csv pdf pptx png jpg jpeg webp mp4 mov m4v avi webm".split()
IMAGES, VIDEOS = "png jpg jpeg webp".split(), "mp4 mov m4v avi webm".split()


def file_kind(base: Text) -> Column:
    """of a base name in lower case."""
    out = F
    for kind, words in KINDS:
        out = out.when(_c(base).rlike(rf"(^|[_\-\s])({words})([_\-\s]|$)"), kind)
    return out.otherwise("material")


def extension_error(ext: Text) -> Column:
    """'binary' for refused, 'unsupported' for unknown extensions, else null."""
    return F.when(_c(ext).isin(REFUSED), "binary").when(~_c(ext).isin(SUPPORTED), "unsupported")


def material_type(base: Text, ext: Text) -> Column:
    """F19."""
    return (
        F.when(_c(ext).isin(["pptx", *IMAGES]) | _c(base).rlike("slide|deck|presentation"), "slide_deck")
        .when(_c(base).rlike("handout|worksheet"), "handout")
        .when(_c(base).rlike("code|snippet|example"), "code_sample")
        .otherwise("reading")
    )


def modality(ext: Text) -> Column:
    """F20."""
    return F.when(_c(ext) == "pdf", "pdf").when(_c(ext) == "pptx", "slide").otherwise("text")


def summary_kind(heading: Text) -> Column:
    """F21."""
    h = F.lower(_c(heading))
    return F.when(h.contains("exam"), "exam_focus").when(h.contains("key"), "key_points").otherwise("overview")


def keywords(heading: Text, most: int = 6) -> Column:
    """the first distinct words of a heading, in lower case."""
    words = F.filter(F.split(F.lower(_c(heading)), r"\s+"), lambda w: w != "")
    return F.slice(F.array_distinct(words), 1, most)


def clamp(x: Text, low: float, high: float, default: float) -> Column:
    """F23."""
    return F.least(F.greatest(F.coalesce(_c(x), F.lit(default)), F.lit(low)), F.lit(high))


def string_list(json: Text) -> Column:
    """the strings in a JSON array; other elements dropped, anything but an array gives an empty one."""
    parsed = F.try_parse_json(_c(json))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def rounded(x: Text, places: int) -> Column:
    """As SQL rounds a double that is not negative: half up, of its product with a power of ten, so 20.02 / 40 gives 0.5; F.round takes the shortest decimal that tells the number."""
    y = _c(x) * F.lit(float(10**places))
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / F.lit(float(10**places))


def confidence(average: Text) -> Column:
    """F26."""
    return F.least(F.lit(0.98), F.round(_c(average) / 2.5, 2))


def gigabytes(size: Text) -> Column:
    """null for none, zero or less."""
    return F.when(_c(size) > 0, F.format_string("%.2f GB", _c(size).cast("double") / 1073741824.0))


def spoken_list(items: Text) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    x = _c(items)
    n = F.size(x)
    last = F.try_element_at(x, n)
    return (
        F.when(n <= 0, "").when(n == 1, F.try_element_at(x, F.lit(1))).when(n == 2, F.array_join(x, " and ")).otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), last))
    )


def sentence(x: Text) -> Column:
    """with a full stop unless it ends in . ! or ?."""
    s = strip(x)
    return F.when((s == "") | s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def without_end_marks(x: Text) -> Column:
    """F29."""
    return strip(F.regexp_replace(strip(x), r"[.!?]+$", ""))


def lower_first(x: Text) -> Column:
    """F29."""
    return F.concat(F.lower(F.substring(_c(x), 1, 1)), F.substring(_c(x), 2, 1_000_000))


def embedded_json(x: Text) -> Column:
    """from the first { to the last }, if that is JSON, else {}."""
    part = F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(part).isNotNull() & (part != ""), part).otherwise("{}")


#: Marks of a model's reasoning, of the prompt's end and of lines that aren't the answer.
REASONING = ["thinking", "analysis", "thought"]
CHANNEL_MARKS = [r"<\|channel>thought", r"<channel\|>", r"<\|turn\|>", r"<turn\|>"]
PROMPT_MARKS = ["Instruction:", "Evidence:", "Answer requirements:"]
SCAFFOLD = r"(?i)^(question:|thinking:|analysis:|answer:\s*$)"


def answer_text(x: Text, question: Text) -> Column:
    """F32: a model's answer without its reasoning, what it repeats of the prompt, numbered lines, and the question if it
    stands in front with a colon (or alone), as one line."""
    closed = _c(x).rlike(r"(?s)<\|channel>thought.*<channel\|>")
    out = F.when(closed, F.regexp_replace(_c(x), r"(?s)\A.*<channel\|>", "")).otherwise(_c(x))
    for pattern in [rf"(?is)<{tag}>.*?</{tag}>" for tag in REASONING] + [f"(?i){mark}" for mark in CHANNEL_MARKS]:
        out = F.regexp_replace(out, pattern, " ")
    out = strip(F.regexp_replace(out, f"(?s)({'|'.join(PROMPT_MARKS)}).*", ""))
    lines = F.filter(F.transform(F.split(out, r"\r?\n"), strip), lambda s: (s != "") & ~s.rlike(SCAFFOLD))
    bare = F.transform(lines, lambda s: strip(F.regexp_replace(s, r"(?i)^final answer:\s*", "")))
    joined = F.array_join(F.filter(bare, lambda s: ~s.rlike(rf"^[0-9]+\.[{SPACE}]")), " ")
    asked = F.regexp_replace(strip(question), "[?!.]+$", "")
    said, sought = F.lower(joined), F.lower(asked)
    cut = F.when((asked == "") | asked.isNull(), joined).when(said == sought, "").when(F.startswith(said, F.concat(sought, F.lit(":"))), F.substr(joined, F.length(asked) + 2))
    return collapse(cut.otherwise(joined))


def unit_payload(json: Text, title: Text) -> Column:
    """struct title, excerpt, content_text, search_text of a JSON object of a unit; names in snake or camel case,
    the title given where it has none, its first 240 characters as excerpt."""
    parsed = F.try_parse_json(_c(json))
    field = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(parsed, f"$.{n}", "string"), F.lit("")) for n in names])
    filled = lambda x, other: F.coalesce(F.nullif(strip(x), F.lit("")), other)
    name = filled(field("title"), _c(title))
    content = F.coalesce(strip(field("content_text", "contentText", "excerpt")), F.lit(""))
    short = filled(field("excerpt"), F.substring(content, 1, 240))
    search = filled(field("search_text", "searchText"), strip(F.concat_ws(" ", name, content)))
    return F.struct(name.alias("title"), short.alias("excerpt"), F.coalesce(F.nullif(content, F.lit("")), F.nullif(short, F.lit("")), name).alias("content_text"), search.alias("search_text"))


def is_refusal(x: Text) -> Column:
    """F33."""
    return F.regexp_replace(normalize(x), r"[.!?]+$", "") == "unsupported"


def first_sentences(x: Text, most: int = 6) -> Column:
    """F34."""
    parts = F.split(strip(x), r"(?<=[.!?])\s+")
    return F.array_join(F.slice(parts, 1, most), " ")


def first_paragraphs(x: Text, most: int = 2) -> Column:
    """F34."""
    parts = F.filter(F.transform(F.split(_c(x), r"\n\s*\n+"), strip), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, most), "\n\n")


#: Character entities of XML.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def xml_decode(x: Text) -> Column:
    """the five named entities, the ampersand last."""
    out = _c(x)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def tag_runs(xml: Text, tag: str) -> Column:
    """the contents of every <tag>...</tag>."""
    return F.regexp_extract_all(_c(xml), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)


def label(kind: str, x: Text) -> Column:
    """'Glossary: ...', 'Material: ...', 'Transcript: ...'."""
    return F.concat(F.lit(kind + ": "), _c(x))


def label_name(x: Text) -> Column:
    """what stands behind the kind."""
    return strip(F.regexp_replace(_c(x), r"^(Glossary|Material|Transcript):\s*", ""))


def checksum(content: Text) -> Column:
    """F37."""
    return F.sha2(_c(content), 256)


def location(page: Text, slide: Text, start: Text, end: Text) -> Column:
    """the page, else the slide, else the range of time, else null."""
    span = F.when(_c(start).isNotNull(), F.concat_ws("-", clock(start), F.when(_c(end).isNotNull(), clock(end))))
    return F.coalesce(F.concat(F.lit("page "), _c(page).cast("string")), F.concat(F.lit("slide "), _c(slide).cast("string")), span)


#: Headings of glossary files that are no terms.
METADATA = [
    "alphabetical glossary starts on the next page",
    "how to use this pdf",
    "included scope",
    "included topic bands",
    "indirect restoration language",
    "occlusal and esthetic vocabulary",
    "operative concepts",
    "restorative materials",
    "scope",
    "total unique terms",
    "unique terms and concise definitions",
    "use note",
    "endodontic terms and definitions",
]


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def is_term(x: Text) -> Column:
    """G1."""
    x = collapse(x)
    fits = (x != "") & (F.length(x) <= 96) & (_words(x) <= 10) & x.rlike("[A-Za-z]")
    return fits & ~F.lower(x).rlike(r"^(a|an|the)\s") & ~x.rlike(r"[.!?]$") & ~x.rlike(r"[.!?].+\s")


def is_definition(x: Text) -> Column:
    """G2."""
    x = collapse(x)
    return (F.length(x) >= 24) | (_words(x) >= 4)


def is_ignored_entry(term: Text, definition: Text) -> Column:
    """G3."""
    t, d = normalize(clean_term(term)), collapse(definition)
    return (t == "") | (d == "") | t.isin(METADATA) | t.contains("glossary") | t.startswith("included ") | d.rlike(r"^[0-9]+$")


def clean_term(x: Text) -> Column:
    """Without a bullet in front, with single spaces, and without the letter of its section."""
    plain = F.regexp_replace(F.regexp_replace(_c(x), r"^[-*]\s+", ""), f"[{SPACE}]+", " ")
    return strip(F.regexp_replace(plain, r"^[A-Z]\s+(?=[A-Z][a-z])", ""))


def keeps_term(x: Text) -> Column:
    """G5."""
    t = normalize(x)
    return (_words(t) <= 7) & (t != "") & ~t.rlike("^[a-z]$") & ~t.rlike("[.!?]") & ~t.contains("glossary") & ~t.isin(METADATA)
