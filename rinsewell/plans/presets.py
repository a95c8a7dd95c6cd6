"""Ready-made step lists."""

from __future__ import annotations


def _step(step_id: str, **options) -> dict:
    return {"id": step_id, "options": options}


# The steps and options of each preset.
PRESETS: dict[str, list[dict]] = {
    "crm": [
        _step("text.trim_whitespace"),
        _step("text.normalize_empty_strings", empty_values=["n/a", "N/A", "none", "-"]),
        _step("text.normalize_case", case="lower"),
        _step("validation.standardize_phone", columns=["phone"], output="us"),
        _step("validation.standardize_zip", columns=["zip"], output="zip5"),
        _step("validation.standardize_state", columns=["state"], output="abbr"),
        _step("dedupe.drop_duplicates", keep="first"),
    ],
    "leads": [
        _step("text.trim_whitespace"),
        _step("text.normalize_case", case="lower"),
        _step("validation.standardize_phone", columns=["phone_number"], output="us"),
        _step("validation.standardize_state", columns=["state"], output="abbr"),
        _step("dedupe.drop_duplicates", keep="first"),
    ],
    "scrape": [
        _step("text.trim_whitespace"),
        _step("text.remove_non_printable", strip=True, collapse_whitespace=True),
        _step("text.normalize_empty_strings", empty_values=["n/a", "N/A", ""]),
        _step("text.normalize_case", case="lower"),
        _step("core.drop_empty"),
        _step("dedupe.drop_duplicates", keep="first"),
    ],
}


def preset(name: str) -> list[dict]:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}: choose one of {sorted(PRESETS)}")
    return PRESETS[name]
