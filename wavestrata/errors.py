"""What can go wrong with an archive."""


class ArchiveError(Exception):
    """Any failure of an archive operation."""


class DuplicateRecording(ArchiveError):
    """A file with the same content is in the archive already."""


class OggFormatError(ArchiveError):
    """Bytes are not a sequence of Ogg pages."""


class VersionMismatch(ArchiveError):
    """The archive was written in another version of the format."""


class IncompleteArchive(ArchiveError):
    """A table of the archive is missing."""


class NotAnArchive(ArchiveError):
    """The folder holds something else."""


class CodecUnavailable(ArchiveError):
    """No decoder or encoder for this codec is installed here."""


class ImportBlocked(ArchiveError):
    """At least one file of a batch cannot be imported."""


class ArchiveBusy(ArchiveError):
    """Another import holds the lock under which ids are given."""
