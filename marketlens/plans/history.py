"""Price history requests: which table answers them, and with which filters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.ids import uuid_to_long
from marketlens.operators.enchants import has_enchant, has_two_enchants, without_enchants
from marketlens.operators.listings import FILTER_DAYS, active_listings, listing_board, named_filters, plain_filters, recent_sales, with_player_name
from marketlens.operators.lookups import id_of_tag
from marketlens.operators.rollup import price_rollup, spike_filter, when_sold

# How far back a request may start to be answered from a finer table.
LIVE_HOURS, HOURLY_DAYS, HOURLY_SPAN_DAYS, DETAIL_DAYS = 1.1, 1.01, 1.09, 1.1
NO_ENCHANT = "None"


@dataclass(frozen=True)
class PriceRequest:
    """What a user asks for; no ``end`` means the time of asking."""

    tag: str
    start: datetime
    end: datetime | None = None
    reforge: str = "Any"
    tier: str = "UNKNOWN"
    enchantments: tuple[tuple[str, int], ...] = ()
    filters: dict[str, str] | None = None
    order: str = "RELEVANT"
    limit: int = 24

    @property
    def is_filtered(self) -> bool:
        return self.reforge != "Any" or self.tier != "UNKNOWN" or bool(self.enchantments) or self.filters is not None


@dataclass
class MarketTables:
    """The frames requests are answered from."""

    sales: DataFrame
    items: DataFrame
    prices: DataFrame | None = None
    live: DataFrame | None = None
    enchantments: DataFrame | None = None
    players: DataFrame | None = None
    headers: DataFrame | None = None
    bids: DataFrame | None = None
    bazaar_ids: DataFrame | None = None


def _text(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def _of_item(df: DataFrame, tables: MarketTables, tag: str) -> DataFrame:
    """Rows of the tag's item; the id is a scalar sub-query, so it reaches the scan as a filter."""
    return df.filter(F.col("item_id") == id_of_tag(tables.items, tag).scalar())


def filtered(auctions: DataFrame, request: PriceRequest, tables: MarketTables, as_of: datetime) -> DataFrame:
    """Apply the request's filters. Named filters replace all others and reach back a month at most."""
    if request.filters is not None and request.start < as_of - timedelta(days=FILTER_DAYS):
        raise ValueError(f"a filtered request may start at most {FILTER_DAYS} days back")
    if request.filters:
        return named_filters(auctions, request.filters)
    if request.enchantments:
        wanted = _of_item(tables.enchantments, tables, request.tag)
        if request.enchantments[0][0] == NO_ENCHANT:
            auctions = without_enchants(auctions, wanted)
        elif len(request.enchantments) > 1:
            auctions = has_two_enchants(auctions, wanted, list(request.enchantments))
        else:
            auctions = has_enchant(auctions, wanted, *request.enchantments[0])
    return plain_filters(auctions, request.reforge, request.tier)


def is_detailed(start: datetime, as_of: datetime) -> bool:
    return start > as_of - timedelta(days=DETAIL_DAYS)


def raw_rollup(request: PriceRequest, tables: MarketTables, as_of: datetime) -> DataFrame:
    sold = _of_item(tables.sales, tables, request.tag).filter(when_sold(_text(request.start), _text(request.end or as_of)))
    unit = "hour" if is_detailed(request.start, as_of) else "day"
    return price_rollup(filtered(sold, request, tables, as_of), ["item_id"], unit)


def price_history(request: PriceRequest, tables: MarketTables, as_of: datetime) -> DataFrame:
    """(item_id, date, avg, max, min, volume): from raw sales, the live hour, hours, or the daily table."""
    if request.is_filtered:
        points = raw_rollup(request, tables, as_of)
    elif request.start > as_of - timedelta(hours=LIVE_HOURS):
        points = _of_item(tables.live, tables, request.tag)
        if points.isEmpty():
            raise LookupError("there was no data found for this item")
    elif request.start > as_of - timedelta(days=HOURLY_DAYS):
        span = PriceRequest(request.tag, as_of - timedelta(days=HOURLY_SPAN_DAYS), as_of)
        points = raw_rollup(span, tables, as_of)
    else:
        end = _text(request.end or as_of)
        stored = _of_item(tables.prices, tables, request.tag)
        points = stored.filter((F.col("date") > F.lit(_text(request.start))) & (F.col("date") <= F.lit(end)))
    points = points.select("item_id", "date", "avg", "max", "min", "volume")
    if tables.bazaar_ids is None:
        return points
    # spikes are cut for commodities only
    known = tables.bazaar_ids.select("item_id").distinct()
    commodity = points.join(known, ["item_id"], "left_semi")
    return spike_filter(commodity, ["item_id"]).unionByName(points.join(known, ["item_id"], "left_anti"))


def recent(request: PriceRequest, tables: MarketTables, as_of: datetime, n: int = 12) -> DataFrame:
    """The newest sales of a request with the seller's name."""
    sold = _of_item(tables.sales, tables, request.tag).filter(when_sold(_text(request.start), _text(request.end or as_of)))
    top = recent_sales(filtered(sold, request, tables, as_of), ["item_id"], ["auction_id"], n)
    return with_player_name(top, tables.players, "seller_id")


def active(request: PriceRequest, tables: MarketTables, as_of: datetime) -> DataFrame:
    """Open listings of a request in its order."""
    begun = (as_of - timedelta(days=14)).replace(hour=0, minute=0, second=0, microsecond=0)
    within = PriceRequest(**{**request.__dict__, "start": begun})
    listings = active_listings(_of_item(tables.headers, tables, request.tag), tables.bids, _text(as_of))
    board = listing_board(filtered(listings, within, tables, as_of), ["item_id"], request.order, request.limit)
    return with_player_name(board, tables.players, "seller_id")


def lowest_bin(tag: str, tables: MarketTables, as_of: datetime, tier: str | None = None, filters: dict[str, str] | None = None, n: int = 2) -> DataFrame:
    """The cheapest buy-it-now listings; a tier becomes a rarity filter unless it is UNCOMMON."""
    chosen = dict(filters or {})
    if tier is not None and tier != "UNCOMMON":
        chosen["Rarity"] = tier
    chosen["Bin"] = "true"
    return active(PriceRequest(tag, as_of, filters=chosen, order="LOWEST_PRICE", limit=n), tables, as_of)


def auction_by_id(auctions: DataFrame, uuid: str, shape=lambda df: df) -> DataFrame:
    """One auction by uuid, else by the text read as its number, in the shape the caller wants.

    ``shape`` is a function from frame to frame.
    """
    wanted = uuid_to_long(F.lit(uuid))
    number = F.lit(uuid).try_cast("bigint")
    either = auctions.filter((F.col("uid") == wanted) | (F.col("uid") == F.coalesce(number, wanted)))
    return either.orderBy(F.col("uid") != wanted).limit(1).transform(shape)
