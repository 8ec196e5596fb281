"""Parameters of the operators, with their defaults. Every "now" is an explicit `as_of`."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

AS_OF = datetime(2024, 1, 31)


@dataclass(frozen=True)
class EventParams:
    """How trades become contrarian events."""

    window_minutes: int = 1440
    min_notional: float = 100.0
    trend_minutes: int = 30
    tail_percentile: float = 95.0
    against_trend_below: float = -0.01


@dataclass(frozen=True)
class EventFilter:
    """Which events an analysis looks at; None leaves a condition out."""

    as_of: datetime = AS_OF
    lookback_days: int = 90
    window_minutes: int = 1440
    min_notional: float = 100.0
    mode: str = "vs_ofi"
    categories: tuple[str, ...] | None = None
    asymmetric_book: bool = False
    new_wallet: bool = False
    max_spread_bps: float | None = None
    ofi_trend_disagree: bool = False
    outcome: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_zscore: float | None = None
    max_zscore: float | None = None
    min_minutes: float | None = None


@dataclass(frozen=True)
class Grid:
    """A strategy grid: one configuration for each combination. The default axes."""

    modes: tuple[str, ...] = ("vs_ofi", "vs_trend", "price_only", "vs_both")
    min_notionals: tuple[float, ...] = (500.0, 1000.0, 5000.0)
    windows: tuple[int, ...] = (30, 60, 120)
    price_ranges: tuple[tuple[float, float], ...] = ((0.10, 0.25), (0.25, 0.40), (0.40, 0.60), (0.60, 0.80), (0.80, 1.00))
    time_ranges: tuple[tuple[float, float], ...] = ((0, 15), (15, 30), (30, 60), (45, 60))
    outcomes: tuple[str, ...] = ("Yes", "No", "all")
    min_events: int = 30
    baseline_win_rate: float = 0.05
    alpha: float = 0.1


@dataclass(frozen=True)
class RiskParams:
    no_trade_seconds: float = 120.0
    stale_ms: float = 10_000.0
    max_spread_bps: float = 500.0
    min_depth_usd: float = 100.0
    single_bet: float = 0.02
    position: float = 0.05
    exposure: float = 0.10
    daily_loss: float = 0.05
    drawdown: float = 0.15
    losses: int = 5


@dataclass(frozen=True)
class SizingParams:
    edge_scale: float = 0.1
    variance: float = 0.25
    fraction: float = 0.25
    max_bet: float = 0.02
    max_position: float = 0.05
    min_usd: float = 5.0


@dataclass(frozen=True)
class ScoreParams:
    anomaly: tuple[float, float, float, float] = (0.35, 0.30, 0.20, 0.15)
    execution: tuple[float, float, float, float] = (0.40, 0.25, 0.25, 0.10)
    composite: tuple[float, float, float] = (0.35, 0.25, 0.40)
    spread_bps: tuple[float, float] = (50.0, 500.0)
    min_depth_usd: float = 100.0
    target_usd: float = 100.0


@dataclass(frozen=True)
class MarketFilter:
    """Thresholds and terms by which markets are tracked or left out."""

    min_volume: float = 1000.0
    min_liquidity: float = 500.0
    whitelist: tuple[str, ...] = field(
        default=(
            "politic", "election", "president", "government", "congress", "parliament", "senate", "minister", "referendum", "vote",
            "economy", "economic", "finance", "inflation", "gdp", "federal reserve", "interest rate", "tariff", "trade war", "recession", "unemployment",
            "regulation", "legal", "court", "lawsuit", "indictment", "verdict",
            "geopolitic", "war", "sanction", "diplomacy", "treaty",
            "trump", "biden", "musk", "elon", "doge",
            "china", "ukraine", "russia", "israel", "iran", "north korea", "taiwan", "eu ", "european union",
            "crypto", "bitcoin", "btc", "ethereum", "eth", "blockchain", "defi", "nft", "stablecoin", "coinbase", "binance",
            "tech", "technology", "artificial intelligence", "ai ", "chatgpt", "openai", "google", "apple", "microsoft", "nvidia", "tesla", "spacex", "starship", "rocket",
            "science", "fda", "vaccine", "clinical trial", "medical", "pandemic", "virus",
            "weather", "hurricane", "storm", "earthquake", "climate", "wildfire", "flood",
            "stock", "dow", "nasdaq", "s&p", "ipo", "bankruptcy", "merger", "acquisition",
            "twitter", "x.com", "tiktok", "youtube", "reddit", "viral", "ban",
        )
    )
    blacklist: tuple[str, ...] = field(
        default=(
            "esports", "call of duty", "league of legends", "lol", "counter-strike", "cs2", "csgo", "dota", "valorant", "overwatch", "rocket league",
            "fortnite", "pubg", "apex legends", "rainbow six",
            "sports", "nfl", "nba", "mlb", "nhl", "soccer", "football", "basketball", "baseball", "hockey", "tennis", "golf", "mma", "ufc", "boxing",
            "cricket", "f1", "formula 1", "nascar",
            "entertainment", "movies", "tv", "music", "awards", "oscars", "grammy", "emmy", "reality tv", "celebrity",
            "gaming", "video games", "twitch", "streaming",
        )
    )
    #: Terms whose markets the trade lists leave out; callers pass their own list.
    excluded_topics: tuple[str, ...] = ("sports", "football", "movie", "album", "error", "signup")
