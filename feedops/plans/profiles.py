"""The two source profiles: parameters of one plan, not two code paths."""

from __future__ import annotations

from dataclasses import dataclass

from feedops.functions import urls
from feedops.functions.labels import MULTI_SOURCE, SINGLE_SOURCE


@dataclass(frozen=True)
class SourceProfile:
    source: str
    holdback: int
    posts_per_poll: int
    media_per_post: int
    batch_size: int
    policy: urls.UrlPolicy
    multi: bool
    telegram: bool
    images_only: bool

    @property
    def listing(self) -> tuple[str, ...]:
        return ("source", "gallery", "crawl_id")


# Hold-back, posts per poll, media per post and batch size of each profile.
SINGLE = SourceProfile(SINGLE_SOURCE, 20, 1, 1, 1, urls.SINGLE_MEDIA, multi=False, telegram=True, images_only=False)
MULTI = SourceProfile(MULTI_SOURCE, 10, 5, 4, 10, urls.MULTI_MEDIA, multi=True, telegram=False, images_only=True)
