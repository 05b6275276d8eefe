"""The flat document model.

A document is a row of metadata and a run of nodes in reading order. ``node_id``
is dense from 0 per document, so order is a sort; ``path`` holds the headings
above a node, so no operator recurses. A section is a heading node and the nodes
up to the next one; nodes before any heading belong to section 0.
"""

from __future__ import annotations

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,strike:boolean,href:string>"
RUNS = f"array<{RUN}>"
#: A cell holds parts, each a run or a paragraph of runs; parts show with a space between.
CELL = f"struct<parts:array<{RUNS}>,colspan:int,rowspan:int,header:boolean>"
ROWS = f"array<array<{CELL}>>"
#: Nested lists are flat in reading order; ``depth`` is 0 at the top, ``ord`` counts from 1 within its list.
ITEMS = f"array<struct<depth:int,ordered:boolean,ord:int,runs:{RUNS}>>"
TABLE = f"struct<caption:string,truncated:boolean,total_rows:int,merged:boolean,complex:boolean,rows:{ROWS}>"
IMAGE = "struct<kind:string,path:string,alt:string,caption:string,ocr:string>"

NODE_FIELDS = (
    f"node_id int, section int, type string, level int, path array<string>, page int, quote int, "
    f"runs {RUNS}, table {TABLE}, items {ITEMS}, code string, language string, image {IMAGE}"
)
NODES = f"doc_id string, {NODE_FIELDS}"

METADATA = (
    "struct<title:string,author:string,subject:string,description:string,keywords:array<string>,created_at:string,modified_at:string,"
    "source_format:string,page_count:int,slide_count:int,sheet_count:int,word_count:int,decorative_images:int>"
)
WARNING = "struct<type:string,message:string,pages:array<int>,count:int>"
DOCUMENTS = f"doc_id string, source string, outcome string, metadata {METADATA}, warnings array<{WARNING}>, notes array<string>"

WARNING_TYPES = (
    "cross_page_table", "table_truncated", "table_complex", "math_detected", "scanned_content", "image_skipped", "font_encoding_unsupported",
    "content_extracted", "audio_quality", "audio_duration", "caption_failed", "topic_failed",
)
OUTCOMES = ("success", "empty_ir", "ocr_required", "parse_error")

#: Limits that behaviour rests on.
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_UNPACKED_BYTES = 500 * 1024 * 1024
MAX_TABLE_ROWS = 500
CHUNK_TOKENS = 800
PASS_MARK = 0.70
