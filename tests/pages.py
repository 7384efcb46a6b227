"""A stand-in for a paged service."""


def fetch(page, options):
    return [{"name": f"s{page}-{i}", "votes": i} for i in range(int(options["size"]))] if page < 3 else None
