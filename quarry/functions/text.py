"""Text functions: each takes and returns columns, so that they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"

#: Words left out of search terms.
STOP_WORDS = (
    "what is are how do does can could would the a an in on at to for of with and or but not this that my your about "
    "from by as it me you we they i be"
).split()
#: The topics a question may name, with the words that name them.
DOMAINS = {
    "experience": r"(?i)\b(work|job|role|company|position|career|employ)\b",
    "skills": r"(?i)\b(skill|technology|framework|language|tool|proficien|stack)\b",
    "education": r"(?i)\b(education|degree|university|college|certif|school|gpa)\b",
    "glossary": r"(?i)\b(what does|mean|definition|acronym|stands for)\b",
}


def words(text: Column) -> Column:
    """Words between white space, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def counted(words: Column) -> Column:
    """The different words of an array with their counts (less: the negative count, word), most frequent first, ties by the word;
    null gives none. A row's words are counted where the row is, without moving them."""
    def runs(ws: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        one = lambda st: F.transform(st, lambda i, j: F.struct((i - F.coalesce(F.get(st, j + 1), F.size(ws))).alias("less"), F.get(ws, i).alias("word")))
        return F.array_sort(F.element_at(F.transform(F.array(first), one), 1))

    some = F.filter(F.transform(F.array(F.sort_array(words)), lambda ws: F.filter(ws, lambda w: w.isNotNull())), lambda ws: F.size(ws) > 0)
    return F.flatten(F.transform(some, runs))


def sha8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def rough_tokens(text: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_for_json(text: Column) -> Column:
    """Control characters become spaces, runs of spaces one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), " +", " "))


def normalize_lines(text: Column) -> Column:
    """Joins wrapped lines: lines that look like code keep their break, a single trailing hyphen joins its word
    to the next line, other breaks become a space. Soft hyphens go, ligatures are spelt out."""
    plain = F.replace(F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    code = lambda x: x.rlike(r"index=|sourcetype=|\||SELECT|WHERE|\{|\}")
    one = lambda x: F.when(code(x), F.concat(x, F.lit("\n"))).when(x.rlike(r"(^|[^-])-$"), F.regexp_replace(x, r"-$", "")).otherwise(F.concat(x, F.lit(" ")))
    joined = F.array_join(F.transform(F.split(plain, "\n", -1), one), "")
    return clean_for_json(joined)


def summarize(text: Column, most: int) -> Column:
    """Up to three sentences: a prefix. Else the first two, a stretch of the middle if over 100 characters
    are left for it, and the last, cut at `most`."""
    flat = fold_space(text)
    parts = F.split(flat, r"(?<=[.!?]) ", -1)
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, 2), " ")
    tail = F.element_at(parts, -1)
    left = F.lit(most) - F.length(head) - F.length(tail) - 10
    middle = F.array_join(F.slice(parts, 3, F.greatest(n - 3, F.lit(0))), " ")
    body = F.when(left > 100, F.concat(head, F.lit(" "), F.substring(middle, F.lit(1), left.cast("int")), F.lit("... "), tail)).otherwise(F.concat(head, F.lit(" ... "), tail))
    return F.when(n <= 3, F.substring(flat, 1, most)).otherwise(F.substring(body, 1, most))


def normalize_tag(tag: Column) -> Column:
    """Lower case, white space to hyphens, other than word characters dropped, hyphens collapsed, 50 at most."""
    t = F.regexp_replace(F.lower(F.trim(tag)), SPACE, "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9_-]", ""), "-+", "-")
    return F.substring(F.regexp_replace(t, "^-|-$", ""), 1, 50)


def normalize_for_hash(text: Column) -> Column:
    return F.lower(fold_space(text))


def search_text(breadcrumb: Column, *lists: Column) -> Column:
    """Everything one searches a chunk by, in lower case, empties skipped."""
    parts = F.concat(F.array(breadcrumb), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.lower(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def search_blob(text: Column, search: Column) -> Column:
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.substring(F.coalesce(search, F.lit("")), 1, 500)))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs, without overlaps; 0 for an empty term."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when(F.length(term) > 0, n).otherwise(F.lit(0)).cast("int")


def search_terms(question: Column) -> Column:
    """Words of a question that are no stop words; if none is left its first five words."""
    found = F.regexp_extract_all(F.lower(question), F.lit(r"[a-zA-Z0-9][A-Za-z0-9_\-]*"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) >= 2))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(found, 1, 5))


def match_tokens(terms: Column) -> Column:
    """Distinct, trimmed, lower-case terms, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))


def domains(question: Column, patterns: Mapping[str, str] = DOMAINS) -> Column:
    return F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def is_greeting(question: Column, greetings: Sequence[str] = ("hi", "hello", "hey", "thanks", "thank", "morning", "evening"), filler: Sequence[str] = ("there", "you", "good", "all")) -> Column:
    """At most four words; all that aren't filler are greetings, and one is."""
    said = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z']+"), F.lit(0))
    core = F.filter(said, lambda w: ~w.isin(list(filler)))
    return (F.size(said) <= 4) & (F.size(core) > 0) & F.forall(core, lambda w: w.isin(list(greetings)))


def codes(text: Column) -> Column:
    """Distinct ticket-like codes, sorted, ten at most."""
    own = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{3,5}-\d{3,4}\b"), F.lit(0))
    more = F.regexp_extract_all(text, F.lit(r"\b(?:INC|TICKET|CASE)[-#: ]?\d+\b"), F.lit(0))
    return F.slice(F.array_sort(F.array_union(own, more)), 1, 10)


def row_code(text: Column, nth: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"\b([A-Z]+-\d+)\b", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("row-"), nth.cast("string")))


def profile_of(name: Column, profiles: Mapping[str, Sequence[str]]) -> Column:
    """The first profile one of whose keywords the name holds, else general."""
    out = F.lit("general")
    for profile, keys in reversed(list(profiles.items())):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(F.lower(name), F.lit(k))
        out = F.when(hit, F.lit(profile)).otherwise(out)
    return out


def content_tags(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Tags any of whose keywords the text holds, sorted."""
    low = F.lower(text)
    hits = []
    for tag, keys in keywords.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(low, F.lit(k))
        hits.append(F.when(hit, F.lit(tag)))
    return F.array_sort(F.array_compact(F.array(*hits)))


def truncate_words(text: Column, most: int) -> Column:
    """Cut at the last space if that is past half of `most`, with an ellipsis."""
    cut = F.substring(text, 1, most)
    space = F.lit(most) - F.locate(" ", F.reverse(cut))  # characters before the last space
    has = F.contains(cut, F.lit(" "))
    short = F.when(has & (space > most / 2), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("…")))


def trim_to_body(text: Column, most: int) -> Column:
    """From the first line of prose on (over 80 characters, not starting like a list or table), cut with a mark."""
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: (F.length(F.trim(x)) > 80) & ~F.trim(x).rlike(r"^[\[\-*#|!]")), F.lit(True))
    body = F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n")).otherwise(text)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n[truncated]"))).otherwise(body)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column, most: int = 50_000) -> Column:
    """Tags, scripts and styles removed, white space folded."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.substring(fold_space(F.regexp_replace(t, r"<[^>]+>", " ")), 1, most)


def ticket_date(text: Column) -> Column:
    """The first of six forms that fits, else null."""
    forms = ("MMM d, yyyy h:mm a", "MMM d, yyyy H:mm", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def flatten_attributes(text: Column, names: Sequence[str]) -> Column:
    """name='value' and name="value" become name=value for the listed names."""
    return F.regexp_replace(text, r"\b(" + "|".join(names) + r")=(?:'([^']*)'|\"([^\"]*)\")", "$1=$2$3")
