"""Errors with a code each."""


class LumenlogError(Exception):
    code = 9000


class ConfigError(LumenlogError):
    code = 1000


class DataError(LumenlogError):
    code = 2000


class ParseError(LumenlogError):
    code = 3000


class QueryError(LumenlogError):
    code = 4000


class ValidationError(LumenlogError):
    code = 7000
