"""String functions of the concept pipeline, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that cannot be a content noun, left out by the noun proxy.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: Column, keep_case: bool = False) -> Column:
    """Runs of a-z of the lower-cased text (of A-Z and a-z of the text as it is, to keep the case); a null text has none."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)) if keep_case else F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def clean(text: Column) -> Column:
    """Only A-Z, a-z and spaces stay."""
    return F.regexp_replace(text, "[^A-Za-z ]", "")


def lemma(token: Column) -> Column:
    """Rule lemmatiser, lower case: -ies to -y, -sses to -ss, a final -s of longer words goes; a model can replace it."""
    t = F.lower(token)
    return (
        F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when((F.length(t) > 4) & t.endswith("sses"), F.substring(t, F.lit(1), F.length(t) - 2))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def lemma_sql(t: str) -> str:
    return f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 4 AND {t} LIKE '%sses' THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"


def query_terms(concept: Column) -> Column:
    """Distinct terms of a concept: lower-cased, split at underscores and white space, empty pieces left out."""
    return F.array_distinct(F.array_remove(F.split(F.lower(concept), r"[_\s]+"), ""))


def concept_key(concept: Column) -> Column:
    """One spelling for both sides of a lookup: lower case, underscores as spaces."""
    return F.lower(F.replace(concept, F.lit("_"), F.lit(" ")))


def capitalised(word: Column) -> Column:
    """The first letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def case_variants(concept: Column) -> Column:
    """Every choice of lower case or capital for each word, joined by underscores, lower case first."""
    words = F.filter(F.split(concept, r"[_\s]+"), lambda w: w != "")
    start = F.array(F.lit("")).cast("array<string>")

    def grow(done: Column, w: Column) -> Column:
        both = F.array(F.lower(w), capitalised(w))
        return F.flatten(F.transform(done, lambda d: F.transform(both, lambda x: F.when(d == "", x).otherwise(F.concat(d, F.lit("_"), x)))))

    return F.aggregate(words, start, grow)


#: Fixed value: the punctuation that caption and question clean-up know.
PUNCTUATION = r"""[.!"()*#:;~]"""


def caption(text: Column, max_words: int = 50) -> Column:
    """Caption clean-up: lower case, punctuation to spaces, runs of blanks to one, ends trimmed, first words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " "), r"\s{2,}", " ")
    t = F.btrim(F.rtrim(t, F.lit("\n")), F.lit(" "))
    return F.array_join(F.slice(F.split(t, " "), 1, max_words), " ")


def question(text: Column, max_words: int = 50) -> Column:
    """Question clean-up: lower case, punctuation deleted, blanks at the end trimmed, first words."""
    t = F.rtrim(F.regexp_replace(F.lower(text), PUNCTUATION, ""), F.lit(" "))
    return F.array_join(F.slice(F.split(t, " "), 1, max_words), " ")


def plain_name(name: Column) -> Column:
    """Lower case, underscores as spaces, slashes as " or ", dots at the end left out."""
    return F.regexp_replace(F.lower(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or "))), r"\.+$", "")


def with_article(name: Column) -> Column:
    """"This is a/an <name>."; the article goes by the first letter (a, e, i, o, u)."""
    n = plain_name(name)
    return F.concat(F.lit("This is "), F.when(n.rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), n, F.lit("."))


def class_name(name: Column) -> Column:
    """One spelling of class names: without a leading number, ``-101`` or the place of a scene; a plane is an airplane."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^[0-9]+\.", ""), "-101$", ""), "_(indoor|outdoor)$", "")
    return F.when(name == "plane", "airplane").otherwise(plain)


def path_concept(path: Column) -> Column:
    """The concept in ``.../number.con_cept/file``."""
    return F.replace(F.split_part(F.element_at(F.split(path, "/"), -2), F.lit("."), F.lit(2)), F.lit("_"), F.lit(" "))


def mentions(prompt: Column, word: Column) -> Column:
    """The prompt, without punctuation, holds the word as a whole or as the start of a plural-like word."""
    p = F.concat(F.lit(" "), F.regexp_replace(F.lower(prompt), r"[^a-z0-9 ]", ""), F.lit(" "))
    w = F.concat(F.lit(" "), F.lower(word))
    return F.contains(p, F.concat(w, F.lit(" "))) | F.contains(p, F.concat(w, F.lit("s")))
