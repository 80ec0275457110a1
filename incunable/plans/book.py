"""A book from blocks to paragraphs: normalise, translate, pass, check, lay out. One lazy plan; only the check's gate acts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as b
from ..operators import layout, qa
from .adapters import placeholder_text, profile


class QualityError(ValueError):
    """The check of a book found issues of high severity."""


def translate_blocks(blocks: DataFrame, mode: str = "fast", config: dict | None = None, adapter=None) -> DataFrame:
    """Adds translated_text by the profile's backend, then the quality, editor and term passes."""
    chosen = profile(config, mode)
    out = adapter(F.col("text")) if adapter else placeholder_text(*(("translated_text",) if "translated_text" in blocks.columns else (F.lit(None).cast("string"),)))
    return b.run_passes(blocks.withColumn("translated_text", out)).withColumn("target_lang", F.lit(chosen["target_lang"]))


def run_book(blocks: DataFrame, mode: str = "fast", config: dict | None = None, adapter=None, gate: bool = True, report_path: str | None = None) -> dict[str, DataFrame]:
    """Every stage's table by name. With `gate`, a book whose check ends in an error raises.

    The report and the issues are written under report_path, if one is given, before the gate can raise.
    """
    normal = b.normalize(b.require(blocks) if gate else blocks)
    translated = translate_blocks(normal, mode, config, adapter)
    report, issues = qa.report(normal, translated), qa.check(normal, translated)
    if report_path:
        report.write.mode("overwrite").json(f"{report_path}/qa_report")
        issues.write.mode("overwrite").json(f"{report_path}/qa_issues")
    if gate and (bad := report.where("status = 'error'").select("book_id").first()):
        raise QualityError(f"book {bad[0]} did not pass its check")
    model = layout.with_heading_levels(translated)
    return {"normalized": normal, "translated": translated, "issues": issues, "report": report, "layout": b.layout_model(model), "paragraphs": layout.paragraph_stream(translated)}
