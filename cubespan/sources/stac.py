"""Items of a SpatioTemporal Asset Catalog: from files, or from a search of an API."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.errors import EmptyStack

#: Short names of public catalogues.
CATALOGS = {"pc": "https://planetarycomputer.microsoft.com/api/stac/v1", "es": "https://earth-search.aws.element84.com/v1"}
ITEMS = "item_id string, collection string, datetime string, cloud_cover double, epsg int, assets map<string,string>"
_FEATURE = "id string, collection string, properties struct<datetime:string,`eo:cloud_cover`:double,`proj:epsg`:int,`proj:code`:string>, assets map<string,struct<href:string>>"


def _items(features: DataFrame) -> DataFrame:
    p = "properties.`{}`".format
    code = F.regexp_extract(F.coalesce(F.col(p("proj:code")), F.lit("")), r"^EPSG:(\d+)$", 1).try_cast("int")
    return features.select(F.col("id").alias("item_id"), "collection", F.col(p("datetime")).alias("datetime"), F.col(p("eo:cloud_cover")).alias("cloud_cover"), F.coalesce(F.col(p("proj:epsg")), code).alias("epsg"), F.transform_values("assets", lambda _, a: a["href"]).alias("assets"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """ITEMS of the item collections in JSON files."""
    own = spark.read.schema(f"features array<struct<{_FEATURE.replace(' string', ':string').replace('properties struct', 'properties:struct').replace('assets map', 'assets:map')}>>").option("multiLine", True).json(path)
    return _items(own.select(F.explode("features").alias("f")).select("f.*"))


def _fetch(url: str, body: dict | None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=60) as r:
        return json.load(r)


def pages(catalog: str, collection: str, bbox: Sequence[float], datetime: str, max_items: int = 100, fetch: Callable[[str, dict | None], dict] = _fetch) -> Iterator[dict]:
    """Features of a search, page by page, max_items at most."""
    url: str | None = f"{CATALOGS.get(catalog, catalog).rstrip('/')}/search"
    body: dict | None = {"collections": [collection], "bbox": list(bbox), "datetime": datetime, "limit": min(100, max_items)}
    left = max_items
    while url and left > 0:
        page = fetch(url, body)
        for feature in page.get("features", [])[:left]:
            left -= 1
            yield feature
        link = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
        url = link and link["href"]
        if link and link.get("method", "GET").upper() == "POST":
            body = {**(body or {}), **link.get("body", {})}
        else:
            body = None


def search(spark: SparkSession, catalog: str, collection: str, bbox: Sequence[float], datetime: str, max_items: int = 100, fetch: Callable[[str, dict | None], dict] = _fetch) -> DataFrame:
    """ITEMS of a search; the box, the dates and the number go to the service. At most max_items items come to the driver."""
    lines = [(json.dumps(f),) for f in pages(catalog, collection, bbox, datetime, max_items, fetch)]
    if not lines:
        raise EmptyStack(f"nothing of {collection} was found for {datetime}")
    raw = spark.createDataFrame(lines, "value string")
    return _items(raw.select(F.from_json("value", _FEATURE).alias("f")).select("f.*"))


def signed(href: str, fetch: Callable[[str, dict | None], dict] = _fetch) -> str:
    """A link that the catalogue "pc" lets be read, from its public signing service."""
    return fetch(f"https://planetarycomputer.microsoft.com/api/sas/v1/sign?href={urllib.parse.quote(href, safe='')}", None)["href"]
