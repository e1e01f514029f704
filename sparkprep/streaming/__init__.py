"""Streaming: apply a fitted plan model to a stream; watermarked dedup."""
