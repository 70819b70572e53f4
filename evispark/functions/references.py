"""Reference strings, as column expressions over (authors array<string>, title, journal, year, volume, pages, doi)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(author: Column) -> Column:
    """Family name and initials: ``Smith, John A`` and ``John A Smith`` give ``Smith JA``."""
    comma = F.instr(author, ",") > 0
    words = F.split(F.trim(author), r"\s+")
    family = F.when(comma, F.trim(F.split(author, ",")[0])).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.split(F.trim(F.split(author, ",")[1]), r"\s+")).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    initials = F.array_join(F.transform(given, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(initials == "", family).otherwise(F.concat_ws(" ", family, initials))


def author_list(authors: Column, most: int = 6) -> Column:
    names = F.transform(authors, short_name)
    return F.when(F.size(authors) > most, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(", et al"))).otherwise(F.array_join(names, ", "))


def short_pages(pages: Column) -> Column:
    """The second page without the digits it shares with the first: 1234-1241 gives 1234-41."""
    a, b = F.regexp_extract(pages, r"^(\d+)\s*[-–]\s*(\d+)$", 1), F.regexp_extract(pages, r"^(\d+)\s*[-–]\s*(\d+)$", 2)
    same = F.aggregate(
        F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n)
    )
    return F.when((a == "") | (F.length(a) != F.length(b)) | (a == b), pages).otherwise(F.concat(a, F.lit("-"), F.substr(b, same + 1)))


def vancouver(authors: Column, title: Column, journal: Column, year: Column, volume: Column, pages: Column) -> Column:
    place = F.concat(year.cast("string"), F.when(volume.isNotNull(), F.concat(F.lit(";"), volume.cast("string"))).otherwise(""), F.when(pages.isNotNull(), F.concat(F.lit(":"), short_pages(pages))).otherwise(""))
    return F.concat(F.concat_ws(". ", author_list(authors), title, journal, place), F.lit("."))


def apa(authors: Column, title: Column, journal: Column, year: Column, volume: Column, pages: Column) -> Column:
    names = F.transform(authors, short_name)
    n = F.size(names)
    listed = F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))
    tail = F.concat_ws(", ", journal, volume.cast("string"), pages)
    return F.concat(listed, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), title, F.lit(". "), tail, F.lit("."))


def bibtex(key: Column, authors: Column, title: Column, journal: Column, year: Column) -> Column:
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value.cast("string"), F.lit("}")))
    fields = F.concat_ws(",\n", field("author", F.array_join(authors, " and ")), field("title", title), field("journal", journal), field("year", year))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), fields, F.lit("\n}"))


def ris(authors: Column, title: Column, journal: Column, year: Column, doi: Column) -> Column:
    lines = F.concat(
        F.array(F.lit("TY  - JOUR")), F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)),
        F.array_compact(F.array(*(F.concat(F.lit(f"{tag}  - "), c.cast("string")) for tag, c in (("TI", title), ("JO", journal), ("PY", year), ("DO", doi))))), F.array(F.lit("ER  - ")),
    )
    return F.array_join(lines, "\n")
