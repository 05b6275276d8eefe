"""Images: which are decoration, which want a caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How names of decorative slide shapes and alternative texts of decorative pictures begin.
SLIDE_NAMES = ("background", "bg_", "rule_", "accent_", "divider", "line_", "border_", "fill_", "stripe_")
PICTURE_TEXTS = (*SLIDE_NAMES, "watermark", "picture 0", "picture 1", "picture 2", "picture 3")
FULL, OVER, TINY, WIDE, TALL = 0.85, 1.05, 0.05, 15.0, 0.067


def _begins(text: Column, fronts: tuple[str, ...]) -> Column:
    own, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for f in fronts:
        out = out | F.startswith(own, F.lit(f))
    return out


def image_kind(kind: Column, w: Column, h: Column, page_w: Column, page_h: Column, name: Column, alt: Column) -> Column:
    """``decorative`` or ``unknown``, by the rules of slides, pages and texts."""
    sized = (page_w > 0) & (page_h > 0)
    thin = (h > 0) & ((w / F.nullif(h, F.lit(0)) > WIDE) | (w / F.nullif(h, F.lit(0)) < TALL))
    tiny = sized & (w < page_w * TINY) & (h < page_h * TINY)
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    bleed = sized & share(w, page_w).between(FULL, OVER) & share(h, page_h).between(FULL, OVER)
    cover = sized & (w >= page_w * FULL) & (h >= page_h * FULL)
    no = lambda c: F.coalesce(c, F.lit(False))
    decorative = F.when(kind == "pptx", no(bleed) | no(thin) | no(tiny) | _begins(name, SLIDE_NAMES)).when(kind == "pdf", no(cover) | no(thin) | no(tiny)).when(kind == "docx", _begins(alt, PICTURE_TEXTS)).otherwise(False)
    return F.when(decorative, "decorative").otherwise("unknown")


def without_images(nodes: DataFrame) -> DataFrame:
    return nodes.where("type <> 'image'")


def to_caption(nodes: DataFrame) -> DataFrame:
    """Image nodes with a file, no caption, and no decoration."""
    return nodes.where((F.col("type") == "image") & F.col("image.path").isNotNull() & (F.coalesce("image.kind", F.lit("")) != "decorative") & F.col("image.caption").isNull())


def attach_media(nodes: DataFrame, media: DataFrame) -> DataFrame:
    """Image nodes take the file at their place among the document's images; files (doc_id, name) go by name."""
    images = nodes.where("type = 'image'").selectExpr("doc_id", "node_id", "row_number() over (partition by doc_id order by node_id) as place")
    files = media.selectExpr("doc_id", "name", "row_number() over (partition by doc_id order by name) as place")
    found = images.join(files, ["doc_id", "place"]).select("doc_id", "node_id", "name")
    return nodes.join(found, ["doc_id", "node_id"], "left").withColumn("image", F.when(F.col("name").isNotNull(), F.col("image").withField("path", F.col("name"))).otherwise(F.col("image"))).drop("name")
