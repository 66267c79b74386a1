"""The engine's tables."""

CHAPTER = "index bigint, title string, content string"
NOVEL = f"title string, author string, cover_image string, status string, num_chapters bigint, description string, genres array<string>, novel_url string, start_chapter string, end_chapter string, chapter_links array<string>, chapters array<struct<{CHAPTER.replace(' ', ':').replace(',:', ',')}>>"
FAILURE = "novel_id string, index bigint, url string, title string, stage string, error string"
IMAGE = "chapter_num string, pos int, url string"
BOOK_ITEM = "pos bigint, kind string, file_name string, title string, in_toc boolean, in_spine boolean"
