"""Language codes, keys, flags and other lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import strip


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key``, null when the table has none."""
    return F.try_element_at(literal_map(table), key)


def iso_of(code: Column) -> Column:
    prefix = F.substring_index(code, "_", 1)
    return F.coalesce(lookup(fv.ISO_BY_PREFIX, prefix), prefix)


def iso_of_code(code: str) -> str:
    """The same for a plain setting."""
    prefix = code.partition("_")[0]
    return fv.ISO_BY_PREFIX.get(prefix, prefix)


def model_code_of(iso: Column, default: str = "eng_Latn") -> Column:
    return F.coalesce(lookup(fv.MODEL_CODE_BY_ISO, iso), F.lit(default))


def display_name(code: Column) -> Column:
    return F.coalesce(lookup(fv.LANGUAGE_NAMES, code), code)


def source_code(iso: Column, configured: str) -> Column:
    """Source language for sentence translation: the detected one, else the setting."""
    known = iso.isNotNull() & (iso != "")
    return F.when(known, model_code_of(iso, configured)).otherwise(F.lit(configured))


def already_target(iso: Column, target_lang: str) -> Column:
    return F.coalesce(iso == iso_of_code(target_lang), F.lit(False))


def digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def cache_key(content_digest: Column, translator: Column, target_lang: Column, features: Column,
              config_hash: Column | None = None) -> Column:
    """Key of a result; ``config_hash`` adds settings the plain key leaves out."""
    wanted = F.filter(F.transform(F.split(features, ","), strip), lambda f: f != "")
    parts = [content_digest, translator, target_lang, F.array_join(F.array_sort(wanted), ",")]
    if config_hash is not None:
        parts.append(config_hash)
    return F.concat_ws("|", *parts)


def feature_flags(features: Column) -> dict[str, Column]:
    """Flags by substring, so ``nosummary`` switches the summary on too."""
    return {
        "do_summary": features.contains("summary"),
        "do_translate": features.contains("translate"),
        "do_wordcloud": features.contains("wordcloud"),
        "do_report": features.contains("report"),
    }


def upload_status(size: Column, filename: Column, max_bytes: int) -> Column:
    """Reject code of an upload, null when it is accepted; the first failing test wins."""
    return (
        F.when(size == 0, 400)
        .when(size > max_bytes, 413)
        .when(~F.lower(F.coalesce(filename, F.lit(""))).endswith(".pdf"), 415)
    )


def job_id(content_digest: Column, sequence: Column) -> Column:
    """Repeatable under task retry, unlike a random id."""
    return digest(F.concat_ws("#", content_digest, sequence.cast("string")).cast("binary"))


def report_url(doc_id: Column, has_report: Column) -> Column:
    return F.when(has_report, F.concat(F.lit("/documents/"), doc_id, F.lit("/report.pdf")))


def image_uri(png: Column) -> Column:
    # base64() folds long output into lines; a data URI must be one run.
    return F.concat(F.lit(fv.IMAGE_PREFIX), F.regexp_replace(F.base64(png), r"\r\n", ""))


def image_bytes(uri: Column) -> Column:
    return F.when(uri.startswith("data:image"), F.unbase64(F.substring_index(uri, ",", -1)))


def status_label(status: Column) -> Column:
    return F.when(status.isin("done", "error"), status).otherwise("processing")


def status_progress(status: Column) -> Column:
    return F.when(status == "done", 100).otherwise(0)


def shown_keywords(keywords: Column) -> Column:
    return F.slice(keywords, 1, fv.SHOWN_KEYWORDS)
