"""V2: attributes and categories from a pluggable model, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Categories and the optional attributes that a model is asked for;
#: brand and model are required of all.
CATEGORIES = {
    "mobile-phones": ("color", "storage_gb", "ram_gb", "network_type"),
    "laptops": ("processor", "ram_gb", "storage_gb", "storage_type", "screen_size", "graphics", "os"),
    "desktops": ("processor", "ram_gb", "storage_gb", "storage_type", "graphics", "os", "form_factor"),
    "tablets": ("color", "storage_gb", "ram_gb", "screen_size", "os", "cellular", "battery_life"),
    "televisions": ("screen_size", "resolution", "refresh_rate", "hdr_support", "smart_tv", "ports", "display_type"),
    "cameras": ("sensor_type", "megapixels", "zoom_range", "video_resolution", "lens_mount", "image_stabilization"),
    "gaming-consoles": ("storage_gb", "generation", "controller_included", "online_support", "backward_compatibility"),
    "smartwatches": ("color", "screen_size", "battery_life", "water_resistance", "health_features", "os", "cellular"),
    "headphones": ("color", "type", "wireless", "noise_cancellation", "battery_life", "connectivity"),
    "mobile-accessories": ("color", "type", "compatibility", "material", "features"),
    "power-banks": ("capacity_mah", "output_ports", "input_type", "fast_charging", "size"),
}
REQUIRED = ("brand", "model")
#: Words of the default model's categories, tried in this order.
KEYWORDS = {
    "power-banks": ("power bank", "powerbank", "portable charger"),
    "mobile-accessories": (" case", " cover", "charger", "cable", "screen guard", "tempered"),
    "headphones": ("earbuds", "earphone", "headphone", "airpods", "headset"),
    "smartwatches": ("watch", "fitness band"),
    "gaming-consoles": ("console", "playstation", "xbox", "nintendo"),
    "cameras": ("camera", "dslr", "mirrorless"),
    "televisions": ("television", " tv ", "smart tv"),
    "tablets": ("tablet", "ipad", " tab "),
    "laptops": ("laptop", "notebook", "macbook", "chromebook"),
    "desktops": ("desktop", "all-in-one", "mini pc"),
    "mobile-phones": ("phone", "mobile", "galaxy", "redmi", "5g"),
}
DEFAULT = ("mobile-phones", 0.1)


def keyword_model(titles: list[str]) -> list[tuple[str, float]]:
    """The default model: the first category with a keyword in the title."""
    out = []
    for t in titles:
        low = f" {t.lower()} "
        hit = next((c for c, words in KEYWORDS.items() if any(w in low for w in words)), None)
        out.append((hit, 0.8) if hit else DEFAULT)
    return out


def classify_batches(df: DataFrame, model: Callable[[list[str]], list[tuple[str, float]]] = keyword_model, batch: int = 50) -> DataFrame:
    """url, category and confidence for df's url and title.

    A batch for which the model raises or returns another number of answers gets
    the default category.  Null titles count as empty.  Join the result by url.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            urls, titles = part["url"].tolist(), ["" if t is None else t for t in part["title"]]
            answers: list[tuple[str, float]] = []
            for at in range(0, len(titles), batch):
                some = titles[at : at + batch]
                try:
                    got = list(model(some))
                except Exception:  # the model is the caller's
                    got = []
                answers += got if len(got) == len(some) else [DEFAULT] * len(some)
            yield pd.DataFrame({"url": urls, "category": [a[0] for a in answers], "confidence": [a[1] for a in answers]})

    return df.select("url", "title").mapInPandas(run, "url string, category string, confidence double")


def extract_attributes(df: DataFrame, model: Callable[[str, list[str]], list[dict]], batch: int = 50) -> DataFrame:
    """url, category and attributes (a map) for df's url, title and category.

    ``model`` gets a category and titles and answers a dictionary a title.  What it
    says of attributes that the category does not have is left out; a batch for
    which it raises or returns another number of answers has none.  Unknown
    categories are asked for brand and model alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found: list[dict | None] = [None] * len(part)
            for category, rows in part.assign(at=range(len(part))).groupby("category", dropna=False, sort=False):
                wanted = {*REQUIRED, *CATEGORIES.get(category, ())}
                for low in range(0, len(rows), batch):
                    some = rows[low : low + batch]
                    try:
                        got = list(model(category, ["" if t is None else t for t in some["title"]]))
                    except Exception:  # the model is the caller's
                        got = []
                    if len(got) == len(some):
                        for at, answer in zip(some["at"], got, strict=True):
                            found[at] = {k: None if v is None else str(v) for k, v in answer.items() if k in wanted}
            yield pd.DataFrame({"url": part["url"], "category": part["category"], "attributes": [f or {} for f in found]})

    return df.select("url", "title", "category").mapInPandas(run, "url string, category string, attributes map<string,string>")
