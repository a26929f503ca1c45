"""Text and list functions on columns. Null gives null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph import lexicons as L

#: Spans of letters and digits that hyphens may link.
LINKED = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
#: Those of LINKED that begin with a capital.
CAPITAL_LINKED = r"(?=[A-Z])(?<![A-Za-z0-9])(?<![A-Za-z0-9]-)" + LINKED
#: What strip() takes away.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without ASCII white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def normalize_key(c: Column) -> Column:
    """Lower case, stripped, white space runs to single blanks."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def without_parentheses(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", "")


def without_descriptors(c: Column) -> Column:
    """Without "total", "by difference" and everything from "from " on; case counts."""
    return F.regexp_replace(F.regexp_replace(c, "total|by difference", ""), "from .*", "")


def candidate_keys(name: Column, strict: bool = False) -> Column:
    """Array of lookup keys of a name, best first, distinct, none empty.

    The name itself, without parentheses, letters and digits only, without descriptors, and its parts
    at each of , / - ( and ). strict drops capital letters in the third form, instead of lowering them.
    """
    plain = F.regexp_replace(name if strict else F.lower(name), r"[^a-z0-9]+", " ")
    whole = F.array(*[normalize_key(x) for x in (name, without_parentheses(name), plain, without_descriptors(name))])
    parts = [F.when(F.contains(name, F.lit(s)), F.transform(F.split(name, f"[{s}]"), normalize_key)).otherwise(F.array().cast("array<string>")) for s in ",/-()"]
    return F.array_distinct(F.filter(F.concat(whole, *parts), lambda x: x != ""))


def normalize_id(c: Column) -> Column:
    """Upper case, stripped, without one MESH:, CTD: or PUBCHEM: in front; empty gives null."""
    return F.nullif(F.upper(F.regexp_replace(strip(c), r"(?i)^(MESH|CTD|PUBCHEM):", "")), F.lit(""))


def token(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits to "_", none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def clip_label(c: Column, n: int, dots: bool = False) -> Column:
    """First n characters, with "..." after them where something was cut if dots."""
    cut = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c) if dots else cut


def list_tokens(c: Column, sep: str = r"\|") -> Column:
    """Tokens of a delimited list, blank ones included; none for null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, sep))


def count_tokens(c: Column, blank: bool = True) -> Column:
    """Number of tokens of a pipe-delimited list, blank ones counted or not; 0 for null or empty."""
    return F.size(list_tokens(c) if blank else F.filter(list_tokens(c), lambda x: strip(x) != ""))


def contains_any(columns, words) -> Column:
    """Whether any of the columns holds any of the words, case ignored; null columns hold none."""
    found = F.lit(False)
    for c in columns:
        for w in words:
            found = found | F.coalesce(F.contains(F.lower(c), F.lit(w.lower())), F.lit(False))
    return found


def direction(text: Column, up=L.UP_ACTIONS, down=L.DOWN_ACTIONS) -> Column:
    """up, down, mixed or unknown, by the words in an action text."""
    is_up, is_down = contains_any([text], up), contains_any([text], down)
    return F.when(is_up & is_down, "mixed").when(is_up, "up").when(is_down, "down").otherwise("unknown")


def sentences(text: Column) -> Column:
    """Array of sentences: parted at white space after . ? or ! and before a capital or "(", stripped, of at least 3 characters."""
    parts = F.split(strip(F.coalesce(text, F.lit(""))), r"(?<=[.?!])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 2)


def linked_spans(text: Column) -> Column:
    """Distinct whole-word spans of a text, where a hyphen is a word border: HLA-DQA1 gives itself, HLA and DQA1."""
    def spans(t):
        parts = F.split(t, "-")
        starts = F.sequence(F.lit(1), F.size(parts))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), "-"))))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LINKED), F.lit(0)), spans)))


def phrase_words(text: Column) -> Column:
    """Lower-case words of a text in order, with commas, colons, hyphens and apostrophes inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w,:'-]*\w"), F.lit(0))


def word_phrases(text: Column, longest: int = 4) -> Column:
    """Distinct lower-case phrases of one to `longest` words, for equi-joins with a phrase lexicon."""
    def phrases(words):
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))

    return let(phrase_words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(phrases(w))))


def names_in(text: Column, names: Column, name=lambda x: x, longest: int = 4) -> Column:
    """Those of an array of names, in lower case with single blanks, that are among the linked_spans() of a text or, with `longest`, its word_phrases(text, longest).

    name: an entry of the array to its text. The text is told apart once, and no phrase of it is made:
    a span lies between signs that are no letters or digits, a phrase between words.
    """
    low = F.lower(text)
    blank = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9-]", " "), F.lit(" "))
    words = F.concat(F.lit(" "), F.array_join(phrase_words(text), " "), F.lit(" "))

    def held(told: Column):
        def holds(x: Column) -> Column:
            n = name(x)
            # beside a span, a hyphen is a border too
            beside = [F.contains(told["blank"], F.concat(F.lit(a), n, F.lit(b))) for a in " -" for b in " -"]
            span = (beside[0] | beside[1] | beside[2] | beside[3]) & n.rlike(rf"^{LINKED}\z")
            return span | (F.contains(told["words"], F.concat(F.lit(" "), n, F.lit(" "))) & (F.size(F.split(n, " ")) <= longest)) if longest else span

        return F.filter(names, holds)

    return let(F.struct(blank.alias("blank"), *([words.alias("words")] if longest else [])), held)


def word_parts(text: Column, wanted: Sequence[str]) -> Column:
    """Those of some lower-case names of one or two words that are among the word_phrases(text, 2), or their parts at - ' , and :, distinct."""
    one, two = [w for w in wanted if " " not in w], [w for w in wanted if w.count(" ") == 1]
    none = F.array().cast("array<string>")

    def found(t: Column) -> Column:
        single = F.array_intersect(F.split(t, r"[\n ]"), F.array(*map(F.lit, one))) if one else none
        # a blank parts two words, a line end their parts
        pairs = [F.when(F.contains(t, F.lit(a + w + b)), w) for w in two for a in " \n" for b in " \n"]
        return F.array_distinct(F.concat(single, F.array_compact(F.array(*pairs)))) if pairs else single

    return let(F.concat(F.lit(" "), F.translate(F.array_join(phrase_words(text), " "), "-',:", "\n\n\n\n"), F.lit(" ")), found)


def phrase_pattern(phrase: Column) -> Column:
    """Pattern that finds a phrase as whole words, case ignored, any white space between its words."""
    escaped = F.regexp_replace(F.lower(strip(phrase)), r"([\\.\[\]{}()*+?^$|/:,-])", r"\\$1")
    return F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(escaped, r"\s+", r"\\s+"), F.lit(r"\b"))


def alias_forms(c: Column) -> Column:
    """Upper-case forms of a symbol, dashes made hyphens, other signs dropped: with and without hyphens."""
    x = F.regexp_replace(F.translate(F.upper(c), "–—−", "---"), "[^A-Z0-9-]", "")
    return F.filter(F.array_distinct(F.array(x, F.replace(x, F.lit("-"), F.lit("")))), lambda f: f != "")


def gene_like(t: Column) -> Column:
    """Whether a token is all capitals with at least 3 characters, a hyphen or a digit."""
    return (F.upper(t) == t) & ((F.length(t) >= 3) | t.rlike("[-0-9]"))


def gene_tokens(text: Column) -> Column:
    """Distinct gene-like tokens of 2 to 16 characters."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9\-]{1,15}\b"), F.lit(0))), gene_like)


def upper_tokens(text: Column) -> Column:
    """Sorted distinct upper-case tokens, the stand-in where there is no gene lexicon."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9\-]{1,15}\b"), F.lit(0))))


def mentions(text: Column, pattern: str) -> Column:
    """Sorted distinct stripped matches of a pattern, case ignored."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?iu)" + pattern), F.lit(0)), strip)))


def dose_mentions(text: Column) -> Column:
    return mentions(text, L.DOSE)


def time_mentions(text: Column) -> Column:
    return mentions(text, L.DURATION)


def species_tags(headings: Column) -> Column:
    """Distinct species of an array of subject headings, in order; empty for null."""
    lookup = F.create_map(*[F.lit(x) for kv in L.SPECIES.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda t: lookup[F.lower(t)]), lambda s: s.isNotNull()))


def primary_species(tags: Column) -> Column:
    """The species that leads; "unspecified" for none."""
    def lead(given: Column) -> Column:
        ranked = F.filter(F.array(*[F.lit(s) for s in L.SPECIES_ORDER]), lambda s: F.array_contains(given, s))
        return F.coalesce(F.get(ranked, F.lit(0)), F.get(given, F.lit(0)), F.lit("unspecified"))

    return let(tags, lead)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD text from parts: month by name or number, kept within 1 to 12, day within 1 to 31, 01 where missing; "" without a year."""
    def two(number, most):
        return F.lpad(F.coalesce(F.least(F.greatest(number, F.lit(1)), F.lit(most)), F.lit(1)).cast("string"), 2, "0")

    names = F.create_map(*[F.lit(x) for kv in L.MONTHS.items() for x in kv])
    m = F.coalesce(month.try_cast("int"), names[F.lower(F.substring(strip(month), 1, 3))])
    y = F.regexp_extract(F.coalesce(year, F.lit("")), r"\d{4}", 0)
    return F.when(y == "", "").otherwise(F.concat_ws("-", y, two(m, 12), two(day.try_cast("int"), 31)))


def polarity(text: Column, positive: str | None = None, negative: str | None = None) -> Column:
    """positive, negative or neutral: one of the first two kinds of cue without the other; else neutral."""
    return one_sided(text.rlike(positive or L.cue("positive")), text.rlike(negative or L.cue("negative")))


def one_sided(positive: Column, negative: Column) -> Column:
    """positive or negative if one flag is set without the other; else neutral."""
    return F.when(positive & ~negative, "positive").when(negative & ~positive, "negative").otherwise("neutral")


def species_label(gene: Column, species: Column, known: Column) -> Column:
    """The gene, with its species in parentheses unless it is in the lexicon or the species is unspecified."""
    return F.when(known | (F.coalesce(species, F.lit("unspecified")) == "unspecified"), gene).otherwise(F.concat(gene, F.lit(" ("), species, F.lit(")")))
