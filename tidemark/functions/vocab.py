"""Closed vocabularies: collections, metrics, flags, bands.  Everything outside them falls into fixed canary metrics."""

from __future__ import annotations

# Collection names to aliases.
COLLECTIONS = {
    "app.bsky.feed.post": "post",
    "app.bsky.feed.like": "like",
    "app.bsky.feed.repost": "repost",
    "app.bsky.graph.follow": "follow",
    "app.bsky.graph.block": "block",
    "app.bsky.graph.listitem": "listitem",
    "app.bsky.actor.profile": "profile",
    "app.bsky.feed.threadgate": "threadgate",
    "app.bsky.feed.postgate": "postgate",
    "app.bsky.actor.status": "actor_status",
}
# Embed types to aliases; the two of them that make a post a quote.
EMBEDS = {
    "app.bsky.embed.images": "images",
    "app.bsky.embed.external": "external",
    "app.bsky.embed.record": "record",
    "app.bsky.embed.recordWithMedia": "recordWithMedia",
    "app.bsky.embed.video": "video",
    "app.bsky.embed.gallery": "gallery",
}
EMBED_OTHER = "other"
QUOTES = ("app.bsky.embed.record", "app.bsky.embed.recordWithMedia")
# Operations, those of them that carry a record's shape, statuses of accounts, and the metrics of what is outside.
OPERATIONS, SHAPED = ("create", "update", "delete"), ("create", "update")
STATUSES, STATUS_OTHER = ("deleted", "deactivated", "takendown", "suspended"), "other"
CANARIES = ("unclassified.kind", "untracked.collection", "malformed.collection", "unclassified.operation", "malformed.commit")
# Aliases of the collections whose records point at another account.
EDGE_COLLECTIONS = ("like", "repost", "follow", "block", "listitem")

# Flags of a window, worst first, and those that keep it out of a baseline.
UNOBSERVED, CLEAN = "unobserved", "clean"
PRECEDENCE = ("unobserved", "gap", "loss", "degraded", "partial", "warming_up", "lagged", "recovering", "seam")
INELIGIBLE = ("partial", "gap", "degraded", "warming_up", "loss")
# Flags of a defect, reasons that are about lateness alone, and ends of a run that are no interruption.
DEFECTS = ("partial", "gap", "loss")
LATENCY_REASONS = ("lag_high",)
NORMAL_STOPS = ("duration_reached", "completed", "signal_sigint", "signal_sigterm")

# Severity bands of a magnitude, highest floor first, and public wording.
SEVERITY = ((3.5, "critical"), (2.0, "high"), (1.0, "med"), (0.585, "low"))
SEVERITY_RANK = {"critical": 4, "high": 3, "med": 2, "low": 1, "info": 0}

# The ratios shown by name (name, numerator, denominator).
RATIOS = (
    ("reply/post", "post.create.reply", "post.create"),
    ("quote/post", "post.create.quote", "post.create"),
    ("repost/post", "repost.create", "post.create"),
    ("like/post", "like.create", "post.create"),
    ("block/follow", "block.create", "follow.create"),
    ("post delete/create", "post.delete", "post.create"),
    ("like delete/create", "like.delete", "like.create"),
    ("follow delete/create", "follow.delete", "follow.create"),
    ("repost delete/create", "repost.delete", "repost.create"),
)
# Episode names by metric (excess, deficit).
EPISODES = {
    "block.create": ("block_burst", "block_lull"),
    "block.delete": ("unblock_burst", "unblock_lull"),
    "like.create": ("like_storm", "like_lull"),
    "like.delete": ("unlike_burst", "unlike_lull"),
    "repost.create": ("repost_storm", "repost_lull"),
    "repost.delete": ("unrepost_burst", "unrepost_lull"),
    "follow.create": ("follow_burst", "follow_lull"),
    "follow.delete": ("unfollow_burst", "unfollow_lull"),
    "listitem.create": ("listadd_burst", "listadd_lull"),
    "listitem.delete": ("listremove_burst", "listremove_lull"),
    "post.delete": ("delete_storm", "delete_lull"),
    "account.active.false": ("account_inactive_burst", "account_inactive_lull"),
}
EPISODE_DEFAULT = ("rate_burst", "rate_lull")


def metrics() -> list[str]:
    """The whole alphabet, sorted: 63 names."""
    out = {f"{alias}.{op}" for alias in COLLECTIONS.values() for op in OPERATIONS}
    for op in SHAPED:
        out |= {f"post.{op}.reply", f"post.{op}.quote"} | {f"post.{op}.embed.{e}" for e in (*EMBEDS.values(), EMBED_OTHER)}
    out |= {"identity.event", "account.event"} | {f"account.active.{a}" for a in ("true", "false", "unknown")}
    return sorted(out | {f"account.status.{s}" for s in (*STATUSES, STATUS_OTHER)} | set(CANARIES))
