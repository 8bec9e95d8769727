"""Column expressions. All are built-in expressions, evaluated inside the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """NULL for a missing or empty text, else the text."""
    return F.nullif(column(c), F.lit(""))


def or_empty(c) -> Column:
    return F.coalesce(column(c), F.lit(""))


def or_default(c, default) -> Column:
    """The default replaces a missing or empty text; the text ``null`` is kept."""
    return F.coalesce(present(c), default if isinstance(default, Column) else F.lit(default))


def fill(template: str, **cols) -> Column:
    """A text template with ``{name}`` slots as one ``concat``; missing values become ''."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(or_empty(cols.get(name, name)))
    return F.concat(*pieces)


def first_token(c) -> Column:
    """First word of a whitespace-separated list ('' when there is none)."""
    return F.regexp_extract(column(c), r"^\s*(\S*)", 1)


def url_encode(c) -> Column:
    """Percent-encode the UTF-8 bytes of everything but letters, digits and ``.~_-``."""
    out = F.url_encode(column(c))
    for form, escape in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(escape))
    return out


def base_dir(c) -> Column:
    """Strip one trailing slash."""
    return F.regexp_replace(column(c), r"/\z", "")


def major_minor(c) -> Column:
    """Drop the last dotted part; a text without a dot stays."""
    return F.regexp_replace(column(c), r"\.[^.]*\z", "")


def drop_blank(items) -> Column:
    return F.filter(column(items), lambda x: x != "")


def merge_csv(c, base: str = C.BASE_EXTRAS) -> Column:
    """Base list, then the given list: no empty items, first occurrence of each, in order."""
    items = F.split(F.concat(F.lit(base + ","), or_empty(c)), "[,\n]")
    return F.array_join(F.array_distinct(drop_blank(items)), ",")


def csv_items(c) -> Column:
    """Items of a comma list, trimmed, inner blanks squeezed, blank items dropped."""
    squeezed = F.transform(
        F.split(or_empty(c), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    )
    return drop_blank(squeezed)


def split_kv(c) -> Column:
    """``K=a=b`` -> (K, a=b); a text without ``=`` is both key and value."""
    parts = F.split(column(c), "=", 2)
    return F.struct(
        parts[0].alias("key"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), column(c)).alias("value"),
    )


def env_entries(c) -> Column:
    """Newline-separated ``KEY=value`` text as an ordered array, blank lines dropped."""
    return F.transform(drop_blank(F.split(column(c), "\n")), split_kv)


def slug(c, prefix: str = C.WORKER_UNIT_PREFIX) -> Column:
    """Lower-case ASCII letters, digits and ``-`` only, behind the prefix."""
    lowered = F.translate(column(c), UPPER, UPPER.lower())
    return F.concat(F.lit(prefix), F.regexp_replace(lowered, "[^a-z0-9-]", ""))


def sql_conn(user, password, host, port, db, template: str = C.SQL_CONN_FORMAT) -> Column:
    return fill(template, user=url_encode(user), password=url_encode(password), host=host, port=port, db=db)


def result_backend(user, password, host, port, db) -> Column:
    return sql_conn(user, password, host, port, db, C.RESULT_BACKEND_FORMAT)


def broker_url(password, host, port, db) -> Column:
    open_form = fill(C.BROKER_FORMAT, host=host, port=port, db=db)
    closed_form = fill(C.BROKER_PASSWORD_FORMAT, password=url_encode(password), host=host, port=port, db=db)
    return F.when(present(password).isNotNull(), closed_form).otherwise(open_form)


def package_urls(version, variant) -> dict[str, Column]:
    formats = {
        "package": C.PACKAGE_FORMAT,
        "tarball": C.TARBALL_FORMAT,
        "primary_url": C.PRIMARY_URL_FORMAT,
        "archive_url": C.ARCHIVE_URL_FORMAT,
    }
    return {name: fill(text, version=version, variant=variant) for name, text in formats.items()}


def optional_args(cores, memory) -> Column:
    """`` -c N`` and `` -m M``; the text 0 means leave the option out."""
    def option(flag, c):
        return F.when(column(c) == "0", "").otherwise(F.concat(F.lit(f" {flag} "), or_empty(c)))

    return F.concat(option("-c", cores), option("-m", memory))


def stamp(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a wall-clock time, free of any session time zone."""
    return F.substring(column(ts).cast("string"), 1, 19)


def log_line(ts, message, level=None) -> Column:
    """``[time] message`` or ``[time] [LEVEL] message``."""
    tag = F.concat(F.lit("["), column(level), F.lit("] ")) if level is not None else F.lit("")
    return F.concat(F.lit("["), stamp(ts), F.lit("] "), tag, column(message))


def run_id(ts) -> Column:
    """Day, month, year, hour, minute, second in one number text."""
    return F.regexp_replace(stamp(ts), r"^(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)$", "$3$2$1$4$5$6")


def run_time(c) -> Column:
    """Time of a run id. Day comes first in the text, so order by this, not by the id."""
    dashed = F.regexp_replace(column(c), r"^(\d\d)(\d\d)(\d{4})(\d\d)(\d\d)(\d\d)$", "$3-$2-$1 $4:$5:$6")
    return dashed.try_cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    return (column(end) - column(start)).cast("interval second").cast("bigint")


def minute_of(ts: str) -> Column:
    return F.expr(f"{ts} - make_dt_interval(0, 0, 0, extract(SECOND FROM {ts}))")


def variant_text(v: Column) -> Column:
    """Text of a JSON value. JSON null and false both give NULL, like a missing key."""
    text = F.try_variant_get(v, "$", "string")
    is_false = (text == "false") & (F.schema_of_variant(v) == "BOOLEAN")
    return F.when(~F.coalesce(is_false, F.lit(False)), text)


def secret_hash(c, secret: str) -> Column:
    """A hash under a key of the caller: without it short values can't be guessed from their hashes."""
    inner = F.sha2(F.concat(F.lit(secret + "\u0001"), column(c)), 256)
    return F.sha2(F.concat(F.lit(secret + "\u0002"), inner), 256)
