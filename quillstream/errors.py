"""Errors with stable codes, as one exception and as payloads."""

from __future__ import annotations

# The codes of errors, with what each means.
CODES = {
    "asr_failed": "the audio could not be transcribed",
    "audio_download_failed": "the audio could not be had",
    "blocked": "the video site refuses the request",
    "duration_exceeded": "the video is longer than two hours",
    "invalid_url": "the address names no video",
    "no_captions": "the video has no captions",
    "provider_unavailable": "no provider takes requests at present",
    "transcript_error": "the transcript could not be made",
}


class TranscriptError(Exception):
    """An error with one of the codes; its message is the code's meaning unless another is given."""

    def __init__(self, code: str = "transcript_error", message: str | None = None, **more: str | None):
        if code not in CODES:
            raise ValueError(f"{code} is no error code")
        super().__init__(message or CODES[code])
        self.code, self.more = code, more

    def payload(self) -> dict:
        return error(self.code, str(self), **self.more)


def error(code: str, message: str, **more: str | None) -> dict:
    """An error payload: status, code, message, and what else is known."""
    return {"status": "error", "code": code, "message": message} | {k: v for k, v in more.items() if v is not None}
