"""A PySpark-native engine for judging, selecting and assembling web text. Names are imported when first used."""

from importlib import import_module

_WHERE = {
    "functions.classify": "classify_url content_type detect_captcha is_likely_content match_keywords score_content validate",
    "functions.text": "api_text captured_body clean_ocr completeness consistency decoded density_curve html_to_text is_complete looks_like_index",
    "functions.json_dig": "longest_text",
    "operators.align": "align auto_clean differences eligible_sources merge",
    "operators.dedup": "across_platforms best_of_many drop_contained keep_first",
    "operators.frames": "dhash drop_repeats drop_similar",
    "operators.jobs": "discovered listed parse search_urls",
    "operators.links": "anchors chapter_lines crawl_document discover first_chapter follow followed_chapter harvest page_links remaining",
    "operators.schedule": "slots",
    "operators.select": "chain content_verdict failures first_layer first_readings judged pick_layer pick_reading quick_or_full verify",
    "operators.serp": "brave_urls duckduckgo_instant_urls duckduckgo_lite_urls exa_urls searxng_urls stats top worth_reading",
    "plans.pipeline": "Config cross_validated run",
    "plans.stages": "Registry Stage fetches",
    "sources.batch": "document read_items result_json result_markdown results search_report",
    "streaming.crawl": "resume",
    "streaming.limiter": "admitted best_texts",
}
_EXPORTS = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_EXPORTS[name]}"), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
