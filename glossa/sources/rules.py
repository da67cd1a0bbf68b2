"""Cleaning rules: literal replacements and header/footer signatures."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

log = logging.getLogger(__name__)

# fixed values: the default rules
REPLACEMENTS = [
    ("　", " "),
    ("l令", "令"),
    ("第0条", "第十条"),
    ("第O条", "第〇条"),
    ("第I条", "第一条"),
    ("第l条", "第一条"),
    ("中华人民共国", "中华人民共和国"),
    ("全国人民代表大", "全国人民代表大会"),
]
SIGNATURES = ["版权所有", "未经许可", "仅供内部使用", "内部资料", "仅供参考"]


@dataclass
class Rules:
    replacements: list[tuple[str, str]] = field(default_factory=lambda: list(REPLACEMENTS))
    signatures: list[str] = field(default_factory=lambda: list(SIGNATURES))


def load(path: str | None = None) -> Rules:
    """Rules from a YAML file on the driver; the defaults without one, none at all if it can't be read."""
    if path is None:
        return Rules()
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        pairs = [(str(x[0]), str(x[1])) for x in data.get("replacements") or [] if isinstance(x, list) and len(x) == 2]
        return Rules(pairs, [str(x) for x in data.get("header_footer_signatures") or []])
    except Exception as e:
        log.warning("rules of %s can't be read: %s", path, e)
        return Rules([], [])
