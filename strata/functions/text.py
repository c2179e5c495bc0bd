"""String rules as column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The roles a file may have.
ROLES = ("entrypoint", "orchestration", "domain_logic", "io_transport", "data_model", "config", "util", "test", "generated", "other")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…"))).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before a space, or ideographic full stop, of the trimmed text; else all of it."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    a, z = F.instr(t, ". "), F.instr(t, "。")
    cut = F.when((a > 0) & (z > 0), F.least(a, z)).when(a > 0, a).when(z > 0, z)
    return F.when(cut.isNull(), t).otherwise(F.regexp_replace(F.substring(t, F.lit(1), cut), r"\s+$", ""))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")


def cap_list(items: Column, most: int, sep: str = ", ") -> Column:
    shown = F.array_join(F.slice(items, 1, most), sep)
    return F.when(F.size(items) > most, F.concat(shown, F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise(shown)


def leaf_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot doesn't begin one."""
    base = F.substring_index(path, "/", -1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def normalize_path(path: Column) -> Column:
    """Without empty and ``.`` segments, ``..`` taking back what stands before it (at the root it is dropped)."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(out, "/")


def module_id(path: Column) -> Column:
    """Dotted module of a Python file; a package's ``__init__`` is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/", ".")


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def coerce_role(role: Column) -> Column:
    return F.when(role.isin(*ROLES), role).otherwise("other")


def path_problem(path: Column) -> Column:
    """Why a path isn't a plain one inside the repository, or null."""
    return (
        F.when(path.startswith("~"), "home").when(path.startswith("/"), "absolute").when(path.rlike("^[a-zA-Z]:"), "drive").when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"[\x00-\x1f]"), "control").when(path.rlike(r"\s"), "space").when(F.contains(path, F.lit("`")), "backtick")
    )


def is_outside(path: Column) -> Column:
    """Whether the path's ``..`` segments climb above its root at any point."""
    depth = F.aggregate(
        F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"),
            F.least(acc["least"], acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("least"),
        ),
    )
    return depth["least"] < 0


def is_gateway_page(body: Column) -> Column:
    return F.lower(F.substring(F.ltrim(body), 1, 200)).rlike(r"^(<!doctype|<html|<\?xml)")


def has_credentials(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+@")


def occurrences(text: Column, part: Column) -> Column:
    """Places where ``part`` stands in ``text``, overlapping ones too; an empty part stands nowhere. Linear in the text."""
    ahead = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when((F.length(part) > 0) & F.contains(text, part), F.regexp_count(text, ahead)).otherwise(0)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 1-based offset."""
    return F.length(F.substring(text, F.lit(1), offset - 1)) - F.length(F.replace(F.substring(text, F.lit(1), offset - 1), F.lit("\n"), F.lit(""))) + 1


def dominant_eol(text: Column) -> Column:
    crlf = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    lf = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) - crlf
    return F.when(crlf > lf, "crlf").otherwise("lf")


def screaming_snake(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "([A-Z])", "_$1"))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5).cast("long")
    m = F.floor(s / 60).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m"), pad(s % 60), F.lit("s"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h"), pad(m % 60), F.lit("m")))


def prose_only(text: Column) -> Column:
    """Without code, links, paths and identifiers."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    for pattern in ("`[^`]*`", r"https?://\S+", r"[\w.-]+/[\w./-]+", r"\b[A-Za-z_]+(?:[._][A-Za-z_]+)+\b", r"\b[a-z]+[A-Z][A-Za-z]*\b", r"\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def code_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise((F.length(F.regexp_replace(text, r"[^(){}\[\]<>;=|&/\\]", "")) / F.length(text)).cast("double"))


#: Scripts that tell a language, function words of Latin-script languages, and words that two of them share.
SCRIPTS = {"zh": "[一-鿿㐀-䶿]", "ja": "[぀-ゟ゠-ヿ]", "ru": "[Ѐ-ӿ]", "hi": "[ऀ-ॿ]"}
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "this", "are", "from", "it", "which"),
    "es": ("el", "la", "los", "las", "de", "que", "en", "con", "para", "una", "por", "del", "se", "es"),
    "pt": ("o", "a", "os", "as", "de", "que", "em", "com", "para", "uma", "por", "do", "da", "é", "não"),
    "de": ("der", "die", "das", "und", "ist", "für", "mit", "den", "von", "auf", "ein", "eine", "nicht"),
}
AMBIGUOUS = ("a", "o", "de", "que", "en", "con", "para", "por", "es", "la", "no", "e")


def latin_scores(prose: Column) -> tuple[Column, dict[str, Column]]:
    """The number of Latin words, and each language's share of function words; shared words count 0.35."""
    words = F.regexp_extract_all(F.lower(prose), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    weigh = lambda own: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when(~w.isin(*own), 0.0).when(w.isin(*AMBIGUOUS), 0.35).otherwise(1.0))
    return F.size(words), {lang: weigh(own) / F.size(words) for lang, own in FUNCTION_WORDS.items()}


def check_latin(prose: Column, lang: str) -> Column:
    """``ok, decided, looks_like`` of a text that should be in a Latin-script language."""
    n, scores = latin_scores(prose)
    order = F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(k).alias("k"), F.lit(lang_).alias("lang")) for k, (lang_, s) in enumerate(scores.items()))))
    best = order[0]
    verdict = lambda ok, decided, like: F.struct(F.lit(ok).alias("ok"), F.lit(decided).alias("decided"), like.alias("looks_like"))
    none = F.lit(None).cast("string")
    foreign = F.length(F.regexp_replace(prose, "[^一-鿿㐀-䶿぀-ゟ゠-ヿЀ-ӿऀ-ॿ]", "")) >= 8
    script = F.when(prose.rlike(SCRIPTS["ja"]), "ja").when(prose.rlike(SCRIPTS["zh"]), "zh").when(prose.rlike(SCRIPTS["ru"]), "ru").when(prose.rlike(SCRIPTS["hi"]), "hi")
    return (
        F.when(foreign, verdict(False, True, script)).when(n < 25, verdict(True, False, none)).when(-best["s"] < 0.02, verdict(True, False, none))
        .when((best["lang"] != lang) & (-best["s"] - scores[lang] < 0.02), verdict(True, False, none)).when(best["lang"] == lang, verdict(True, True, none)).otherwise(verdict(False, True, best["lang"]))
    )


def check_script(prose: Column, lang: str) -> Column:
    """``ok, decided, looks_like`` of a text that should be in zh, ja, ru or hi."""
    verdict = lambda ok, decided, like: F.struct(F.lit(ok).alias("ok"), F.lit(decided).alias("decided"), like.alias("looks_like"))
    none = F.lit(None).cast("string")
    has = {k: prose.rlike(v) for k, v in SCRIPTS.items()}
    short = F.length(F.regexp_replace(prose, r"[\s\p{P}]", "")) < 12
    out = F.when(short | (code_ratio(prose) > 0.08), verdict(True, False, none))
    if lang == "ja":
        return out.when(has["ja"], verdict(True, True, none)).when(has["zh"], verdict(False, True, F.lit("zh"))).otherwise(verdict(False, True, none))
    if lang == "zh":
        out = out.when(has["zh"] & has["ja"], verdict(False, True, F.lit("ja")))
    other = F.coalesce(*(F.when(has[k], k) for k in SCRIPTS if k != lang))
    return out.when(has[lang], verdict(True, True, none)).otherwise(verdict(False, True, other))


def markdown_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\]\(([^)#\s]+\.md)\)"), F.lit(1))


def register_id(text: Column) -> Column:
    """A register's id: lower case, dashes, ``reg-`` before it; null if nothing valid is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"[_\s]+", "-")
    named = F.when(t.startswith("reg-"), t).otherwise(F.concat(F.lit("reg-"), t))
    return F.when(named.rlike("^reg-[a-z0-9][a-z0-9-]*$"), named)


def csv_field(text: Column) -> Column:
    """A field quoted only where it must be."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, z in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(z))
    return text


def join_key(prefix: Column, key: Column) -> Column:
    """``readWorkers`` under ``generate`` as ``generateReadWorkers``; an empty prefix leaves the key alone."""
    return F.when(prefix == "", key).otherwise(F.concat(prefix, F.upper(F.substring(key, 1, 1)), F.substring(key, F.lit(2), F.length(key))))


def scoped_env_name(app: str, command: Column, key: Column) -> Column:
    """``APP_COMMAND_READ_WORKERS``, or ``APP_READ_WORKERS`` where the command is empty."""
    return F.concat(F.lit(app + "_"), F.when(command == "", "").otherwise(F.concat(F.upper(command), F.lit("_"))), screaming_snake(key))


def short_description(title: Column, description: Column) -> Column:
    """``title: `` and the description up to its first full stop before a space, or ideographic full stop."""
    return F.concat(title, F.lit(": "), F.element_at(F.split(description, r"(?<=\.)\s|。"), 1))


def close_fence(plan: Column) -> Column:
    """``text, repaired``: a plan whose last code fence stays open gets it closed by the fence that opened it."""
    form = r"^[ \t]*(`{3,}|~{3,})(.*)$"

    def step(opened: Column, line: Column) -> Column:
        mark, info = F.regexp_extract(line, form, 1), F.regexp_extract(line, form, 2)
        closes = (F.substring(mark, 1, 1) == F.substring(opened, 1, 1)) & (F.length(mark) >= F.length(opened)) & (F.trim(info) == "")
        return F.when(mark == "", opened).when(opened == "", mark).when(closes, "").otherwise(opened)

    opened = F.aggregate(F.split(plan, r"\r?\n"), F.lit(""), step)
    closed = F.concat(F.regexp_replace(plan, r"\s+\z", ""), F.lit("\n"), opened, F.lit("\n"))
    return F.struct(F.when(opened == "", plan).otherwise(closed).alias("text"), (opened != "").alias("repaired"))


def numbered_lines(text: Column, first: Column, last: Column, most: int = 60_000) -> Column:
    """Lines ``first`` to ``last`` (null: from the first, to the last one), numbered in five places; a longer answer is cut and says so."""
    lines = F.split(text, "\n")
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1))).cast("int")
    end = F.least(F.size(lines), F.coalesce(last, F.size(lines))).cast("int")
    chosen = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))
    number = lambda k: F.concat(F.repeat(F.lit(" "), F.greatest(5 - F.length((start + k).cast("string")), F.lit(0))), (start + k).cast("string"))
    whole = F.array_join(F.transform(chosen, lambda line, k: F.concat(number(k), F.lit("|"), line)), "\n")
    return F.concat(truncate(whole, most), F.when(F.length(whole) > most, "\n… (truncated — request a narrower line range)").otherwise(""))


#: The phases, and what stands for several of them.
PHASES = ("1", "2a", "2b", "2c", "3")
PHASE_GROUPS = {"all": PHASES, "2": ("2a", "2b", "2c")}


def expand_phases(spec: Column) -> Column:
    """``phases, problem``: the phases a comma list names, in its order; an unknown word or an empty list is a problem."""
    words = F.filter(F.transform(F.split(F.lower(spec), ","), lambda w: F.trim(w)), lambda w: w != "")
    unknown = F.filter(words, lambda w: ~w.isin(*PHASES, *PHASE_GROUPS))
    named = lambda w: F.when(w == "all", F.array(*map(F.lit, PHASES))).when(w == "2", F.array(*map(F.lit, PHASE_GROUPS["2"]))).otherwise(F.array(w))
    phases = F.array_distinct(F.flatten(F.transform(words, named)))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown phase "), F.element_at(F.when(F.size(unknown) > 0, unknown), 1))).when(F.size(words) == 0, "no phases")
    return F.struct(F.when(problem.isNull(), phases).alias("phases"), problem.alias("problem"))
