"""Settings of an experiment, and the named ends of the scenario periods."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tallycast.plans.backtest import Rolling
from tallycast.plans.forecast import Settings


@dataclass(frozen=True)
class Params:
    """The published defaults of the quarter-hourly city data."""

    model: str = "nb_share"
    profile: str = "forts"
    cells: int = 40
    cells1: int = 64
    cells2: int = 64
    learning_rate: float = 0.001
    layers: int = 2
    epochs: int = 150
    dropout: float = 0.05
    samples: int = 100
    rank: int = 10
    conditioning: int = 100
    target_dim_sample: int = 20
    pred_days: int = 1
    minutes: int = 15
    lags: tuple[int, ...] = (1, 2, 4, 12, 24, 48)
    windows: int = 6
    train_start: str = "2024-03-01 00:00:00"
    train_end: str = "2024-03-25 23:45:00"
    test_start: str = "2024-03-25 00:00:00"
    test_end: str = "2024-03-31 23:45:00"

    @property
    def steps_per_day(self) -> int:
        return 24 * 60 // self.minutes

    @property
    def horizon(self) -> int:
        return self.steps_per_day * self.pred_days

    def settings(self, test_start_index: int, seed: str = "0", last: int | None = None) -> Settings:
        """The forecaster's view; network sizes and training lengths only label a run."""
        rolling = Rolling(self.horizon, self.steps_per_day, self.windows, test_start_index)
        return Settings(
            rolling=rolling, samples=self.samples, seed=seed, minutes=self.minutes, context=self.horizon, rank=self.rank,
            conditioning=self.conditioning, last=last,
        )


CITY = Params()
# Where the half-hourly station data differ.
STATION = replace(
    CITY, cells1=60, cells2=20, dropout=0.1, conditioning=50, minutes=30, windows=31, train_start="2019-04-01 01:00:00",
    train_end="2022-01-31 00:30:00", test_start="2022-02-01 01:00:00", test_end="2022-04-11 00:30:00",
)
# A smoke setting: the smallest run that still goes through every step.
FAST = replace(CITY, samples=1, conditioning=10, rank=5, epochs=1, cells=1)

# Named ends of the station data's special days.
SCENARIOS = (
    ("normal1", "2022-05-19 00:30:00"), ("normal2", "2022-05-21 00:30:00"),
    ("concert1", "2022-03-16 00:30:00"), ("concert2", "2022-05-14 00:30:00"),
    ("event1", "2022-04-02 00:30:00"), ("event2", "2022-05-08 00:30:00"),
    ("pert1", "2022-04-04 00:30:00"), ("pert2", "2022-03-02 00:30:00"), ("pert3", "2022-04-06 00:30:00"),
    ("pert4", "2022-05-20 00:30:00"), ("pert5", "2022-03-01 00:30:00"),
)
