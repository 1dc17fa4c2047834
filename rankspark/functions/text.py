r"""Text expressions: trimming, contacts, languages, names, dates and file names.

Java's \w, \d, \s, \b and (?i) are ASCII; the (?U) and (?iu) prefixes make them Unicode.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EVAL_PREFIX = "resume_csv_"

# --- fixed values: patterns, bounds and word lists that define the results ------------
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s\-\(\)]{7,}\d"
BULLETS = "•∙·●▪▶▸‣\\-*+"
SKILL_BULLETS = "•∙·●▪▶▸‣–—\\-*+"
GENERIC_ORGS = ("ai", "api", "ml", "dl", "ui", "ux", "qa", "ux/ui", "ml/ai", "rest", "sql", "nlp", "css", "html", "js", "crud", "etl", "rag", "llm", "cv")
MONTHS = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r"|январ[ьяе]|феврал[ьяе]|март[а]?|апрел[ьяе]|ма[яй]|июн[ьяе]|июл[ьяе]|август[а]?|сентябр[ьяе]|октябр[ьяе]|ноябр[ьяе]|декабр[ьяе]"
)
PRESENT = r"present|now|current(?:\s+time)?|currently|настоящее\s+время|по\s+наст\.?|по\s+настоящее"
DATE = rf"(?:(?:0?[1-9]|1[0-2])[/.\-](?:19|20)\d{{2}}|(?:{MONTHS})\s+(?:19|20)\d{{2}}|(?:19|20)\d{{2}})"
RANGE_DASH = r"\s*[—–\-→]\s*"
NAME_CAPITAL = r"^[A-ZА-ЯЁ][a-zа-яё]+(?:[-‑][A-ZА-ЯЁ][a-zа-яё]+)?$"
NAME_CAPS = r"^[A-ZА-ЯЁ]{2,}(?:[-‑][A-ZА-ЯЁ]{2,})?$"
SKILL_STOPS = ("and", "or", "и", "или", "etc", "etc.", "и т.д.")
SKILL_CONTACTS = ("http", "https", "@", ".com", ".ru", ".kz", "gmail", "telegram")
PHRASE_VERBS = (
    "developed", "designed", "implemented", "built", "created", "managed", "led", "worked", "supervised",
    "написал", "разработал", "разрабатывал", "создал", "внедрил", "проектировал", "руководил", "выполнял", "занимался",
)
EDGES = r"^[ \t\-—–:,.]+|[ \t\-—–:,.]+$"
CATEGORY = r"^\s*([\w\s&/+\-.]{2,50})\s*[:：]\s*(.+)$"
ITEM_SPLIT = r"\s*[,;|]\s*|\s{2,}"
SKILL_NUMBERS = (r"^(19|20)\d{2}$", r"^\d{2,}[\s\-./]*\d*$")
PHRASE_NUMBERS = (r"^\d+$", r"\d{2}[.\-/]\d{2}", r"\d{2,}\s+\d{2,}")
PHRASE_CONTACTS = ("http", "https", "www", "gmail", "@", ".com", ".ru", ".kz", "telegram")
# ---------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_match(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def clamp01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def tokens(c: Column) -> Column:
    """White-space separated tokens; an empty array for blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: t != "")


# --- contacts and languages --------------------------------------------------------------


def email(c: Column) -> Column:
    return F.when(c.contains("@"), first_match(c, EMAIL))


def phone(c: Column) -> Column:
    """The first phone-like run with 7 to 15 digits."""
    found = F.regexp_extract_all(c, F.lit("(?U)" + PHONE), F.lit(0))
    digits = F.filter(found, lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")).between(7, 15))
    return strip(F.get(digits, F.lit(0)))


def languages(c: Column) -> Column:
    """["ru"], ["en"], both or none: alphabets with over 5 % of the letters. Letters are counted
    once each, by what a text is shorter without them."""
    letters = lambda alphabet: F.length(c) - F.length(F.regexp_replace(c, f"[{alphabet}]+", ""))
    counted = F.array(F.struct(letters("А-Яа-яЁё").alias("ru"), letters("A-Za-z").alias("en")))

    def found(x: Column) -> Column:
        n = F.nullif(x["ru"] + x["en"], F.lit(0))
        return F.array_compact(F.array(F.when(x["ru"] / n > 0.05, "ru"), F.when(x["en"] / n > 0.05, "en")))

    return F.flatten(F.transform(counted, found))


def is_russian(c: Column) -> Column:
    return c.rlike("[\\u0400-\\u04FF]")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


# --- names -------------------------------------------------------------------------------


def valid_name(c: Column) -> Column:
    """The text if it is two or three tokens, all Capitalised or all ALLCAPS; else null. Longer texts
    are told by their first tokens, without splitting them."""
    t, few = tokens(c), r"(?U)^\s*+\S++\s++\S++(?:\s++\S++)?+\s*+$"
    shaped = F.forall(t, lambda x: x.rlike(NAME_CAPITAL)) | F.forall(t, lambda x: x.rlike(NAME_CAPS))
    return F.when(c.rlike(few), F.when(F.forall(t, lambda x: F.length(x) >= 2) & shaped, c))


# --- dates -------------------------------------------------------------------------------


def normalised_end(c: Column) -> Column:
    return F.when(F.lower(strip(c)).rlike(f"(?iu)^(?:{PRESENT})"), "present").otherwise(strip(c))


def _range_parts(text: Column) -> Column:
    pattern = f"(?iu)({DATE}){RANGE_DASH}({DATE}|{PRESENT})"
    return F.struct(strip(F.regexp_extract(text, pattern, 1)).alias("start"), normalised_end(F.regexp_extract(text, pattern, 2)).alias("end"))


def date_ranges(c: Column) -> Column:
    """array<struct<start, end>>: ranges first, then single dates with a null start."""
    whole = f"(?iu){DATE}{RANGE_DASH}(?:{DATE}|{PRESENT})"
    ranges = F.transform(F.regexp_extract_all(c, F.lit(whole), F.lit(0)), _range_parts)
    rest = F.regexp_replace(c, whole, "\u0000")
    singles = F.transform(F.regexp_extract_all(rest, F.lit(f"(?iu){DATE}"), F.lit(0)), lambda d: F.struct(F.lit(None).cast("string").alias("start"), strip(d).alias("end")))
    return F.concat(ranges, singles)


def first_dates(c: Column) -> Column:
    """Element 0 of date_ranges, or null: the first range, else the first single date. Every date
    ends in a year, so a text without one isn't searched."""
    found = lambda pattern: F.filter(F.array(F.regexp_extract(c, f"(?iu){pattern}", 0)), lambda m: m != "")
    ranged = F.get(F.transform(found(f"{DATE}{RANGE_DASH}(?:{DATE}|{PRESENT})"), _range_parts), F.lit(0))
    single = F.get(F.transform(found(DATE), lambda d: F.struct(F.lit(None).cast("string").alias("start"), strip(d).alias("end"))), F.lit(0))
    return F.when(c.rlike(r"(?:19|20)\d{2}"), F.coalesce(ranged, single))


def without_dates(c: Column) -> Column:
    out = F.regexp_replace(c, f"(?iu){DATE}{RANGE_DASH}(?:{DATE}|{PRESENT})", "")
    out = F.regexp_replace(out, f"(?iu){DATE}", "")
    out = F.regexp_replace(F.regexp_replace(out, "(?U)" + RANGE_DASH, " "), r"(?U)\s+", " ")
    return F.regexp_replace(strip(out), EDGES, "")


# --- organisations, bullets, skills, phrases ---------------------------------------------


def looks_like_org(c: Column) -> Column:
    s = strip(c)
    n = F.size(tokens(s))
    first = F.substring(s, 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    shape = (n == 1) | ((n <= 2) & s.contains("."))
    return F.coalesce((s != "") & (F.length(s) <= 20) & ~F.lower(s).isin(*GENERIC_ORGS) & upper & shape, F.lit(False))


def org_in_line(line: Column, orgs: Column) -> Column:
    """The first organisation of ``orgs`` that stands in the line as whole words."""
    low = F.lower(line)

    def meets(o: Column) -> Column:
        name = F.lower(strip(o))
        return (F.length(name) > 3) & ~name.isin(*GENERIC_ORGS) & F.regexp_like(low, F.concat(F.lit("(?U)\\b\\Q"), name, F.lit("\\E\\b")))

    return F.get(F.filter(orgs, meets), F.lit(0))


def is_residue(c: Column) -> Column:
    """Null, empty, up to three characters or a generic acronym: not a role."""
    s = strip(c)
    return F.coalesce(s.isNull() | (F.length(s) <= 3) | F.lower(s).isin(*GENERIC_ORGS), F.lit(True))


def without_bullet(c: Column, glyphs: str = BULLETS) -> Column:
    return F.regexp_replace(c, rf"(?U)^\s*[{glyphs}]\s*", "")


def is_bullet(c: Column) -> Column:
    return without_bullet(c) != c


def skill_payload(line: Column) -> Column:
    """A line without its bullet and without a `Category:` before its items."""
    s = without_bullet(strip(line), SKILL_BULLETS)
    found = F.regexp_extract(s, f"(?Ud){CATEGORY}", 2)
    return F.when(found != "", found).otherwise(s)


def split_items(c: Column) -> Column:
    """Items between , ; | outside brackets; items with double spaces are split there too."""
    chars = F.split(F.coalesce(c, F.lit("")), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, ch: Column) -> Column:
        opens, closes = ch.isin("(", "[", "{"), ch.isin(")", "]", "}")
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        cut = ch.isin(",", ";", "|") & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.when(cut, F.lit("\u0001")).otherwise(ch)).alias("out"))

    items = F.split(F.aggregate(chars, start, step)["out"], "\u0001")
    parts = F.flatten(F.transform(items, lambda x: F.when(x.contains("  "), F.split(x, f"(?U){ITEM_SPLIT}")).otherwise(F.array(x))))
    kept = F.filter(parts, lambda x: strip(x) != "")
    return F.transform(kept, lambda x: F.regexp_replace(strip(x), r"^\.+|\.+$", ""))


def is_skill_noise(c: Column) -> Column:
    low, n = F.lower(strip(c)), F.length(c)
    has = F.lit(False)
    for part in SKILL_CONTACTS:
        has = has | low.contains(part)
    return (n < 2) | (n > 60) | c.rlike(f"(?U){SKILL_NUMBERS[0]}") | c.rlike(f"(?U){SKILL_NUMBERS[1]}") | low.isin(*SKILL_STOPS) | has


def is_junk_phrase(c: Column) -> Column:
    return is_junk(strip(c), F.lower(strip(c)))


def is_junk(p: Column, low: Column) -> Column:
    """is_junk_phrase() of a phrase without outer white space, and the same in lower case."""
    has = F.lit(False)
    for part in PHRASE_CONTACTS:
        has = has | low.contains(part)
    shape = p.rlike("(?U)" + "|".join(PHRASE_NUMBERS))
    return (F.length(p) <= 2) | shape | low.isin(*PHRASE_VERBS) | has


def name_tokens(name: Column) -> Column:
    """What of a name counts for dominated_by()."""
    return F.filter(tokens(F.lower(F.coalesce(name, F.lit("")))), lambda x: F.length(x) > 1)


def dominated_by(phrase: Column, name: Column) -> Column:
    """At least half of the phrase's tokens are tokens (longer than 1) of the name."""
    return mostly_of(tokens(F.lower(phrase)), name_tokens(name))


def mostly_of(parts: Column, names: Column) -> Column:
    """At least half of the parts are names; false without parts or names, or if one is null."""
    return F.coalesce((F.size(names) > 0) & (F.size(parts) > 0) & (F.size(F.filter(parts, lambda x: F.array_contains(names, x))) / F.nullif(F.size(parts), F.lit(0)) >= 0.5), F.lit(False))


# --- file names, labels, formats ---------------------------------------------------------


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)/*$", 1)


def sanitize_filename(c: Column) -> Column:
    """Base name with only word characters, dots and dashes; the suffix in lower case."""
    base = F.regexp_replace(strip(basename(c)), " ", "_")
    clean = F.regexp_replace(base, r"(?U)[^\w.\-]+", "_")
    clean = F.when(clean == "", "uploaded.bin").otherwise(clean)
    suffix = F.regexp_extract(clean, r"^.+(\.[^.]+)$", 1)
    return F.concat(F.substring(clean, F.lit(1), F.length(clean) - F.length(suffix)), F.lower(suffix))


def temp_name(c: Column) -> Column:
    return F.concat(F.lit("_tmp_"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 8), F.lit("_"), sanitize_filename(c))


def final_name(id_: Column, c: Column) -> Column:
    return F.concat_ws("_", id_.cast("string"), sanitize_filename(c))


def source_to_category(c: Column) -> Column:
    """`3_information_technology.json` to `INFORMATION-TECHNOLOGY`."""
    return F.upper(F.translate(F.regexp_replace(F.regexp_replace(c, r"\.json$", ""), r"^[^_]*_", ""), "_", "-"))


def excerpt(c: Column, most: int = 3000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [truncated]"))).otherwise(c)


def fixed(c: Column, places: int) -> Column:
    """A number with so many digits after the point, as C's printf writes it: rounded from the double's exact
    value, half to even. Java's formats don't: format_string() rounds the shortest decimal form, half up (0.2985
    is a double below it), format_number() gives 0.000 for 0.0005, a double above it. Arrow batches keep null and NaN apart."""

    @F.arrow_udf("string")
    def written(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{places}f}" for v in values.to_pylist()], pa.string())

    return written(c.cast("double"))


def score_bar(c: Column) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(c * 5).cast("int")))
    return F.concat(F.repeat(F.lit("●"), n), F.repeat(F.lit("○"), F.lit(5) - n), F.lit("  "), fixed(c, 2))


def match_line(rank: Column, score: Column, name: Column, mail: Column, source: Column) -> Column:
    """Null if rank, score or source is."""
    who = F.coalesce(name, F.lit("?"))
    line = F.format_string("  %d. (%s) %s <%s>  %s", rank.cast("int"), fixed(score, 3), who, F.coalesce(mail, F.lit("?")), basename(source))
    return F.when(rank.isNotNull() & score.isNotNull() & source.isNotNull(), line)


def vacancy_text(title: Column, description: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n\n"), description)).otherwise(description)


# --- scorer's answers and prompts --------------------------------------------------------


def parsed_score(answer: Column) -> Column:
    """struct<score, explanation> of a scorer's JSON answer, strict first, then the outermost
    braces; null if it doesn't hold a score and an explanation of 1 to 600 characters."""
    kind = "struct<score:double,explanation:string>"

    def read(text: Column) -> Column:
        got = F.from_json(text, kind)
        ok = got["score"].isNotNull() & F.coalesce(F.length(got["explanation"]).between(1, 600), F.lit(False))
        return F.when(ok, F.struct(clamp01(got["score"]).alias("score"), got["explanation"].alias("explanation")))

    strict = F.when(strip(answer).rlike(r"(?s)^\{.*\}$"), read(answer))
    return F.coalesce(strict, read(F.regexp_extract(answer, r"(?s)\{.*\}", 0)))


def prompt(title: Column, description: Column, parsed: Column, raw_text: Column) -> Column:
    """What a scorer reads of a vacancy and a candidate; long parts are cut."""
    skills = F.array_join(F.slice(parsed["skills"], 1, 30), "; ")
    jobs = F.array_join(F.transform(F.slice(parsed["experience"], 1, 5), lambda e: F.concat_ws(" ", F.lit("-"), F.coalesce(e["role"], F.lit("?")), F.lit("@"), F.coalesce(e["organization"], F.lit("?")), F.concat(F.lit("("), F.coalesce(e["start"], F.lit("?")), F.lit(" - "), F.coalesce(e["end"], F.lit("?")), F.lit(")")))), "\n")
    schools = F.array_join(F.transform(F.slice(parsed["education"], 1, 3), lambda e: F.concat_ws(" ", F.lit("-"), F.coalesce(e["degree"], F.lit("?")), F.lit("@"), F.coalesce(e["institution"], F.lit("?")))), "\n")

    def part(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.when(F.coalesce(c, F.lit("")) == "", "(none)").otherwise(c))

    text = F.when(F.length(raw_text) > 4000, F.concat(F.substring(raw_text, 1, 4000), F.lit("… [truncated]"))).otherwise(raw_text)
    return F.concat_ws("\n", part("title", title), part("description", F.substring(description, 1, 3000)), part("skills", skills), part("experience", jobs), part("education", schools), part("text", text))
