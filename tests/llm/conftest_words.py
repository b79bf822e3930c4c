import re


def words(text):
    """Words of the contract, the slow way."""
    return re.findall("[^\x20\x09-\x0d]+", text or "")
