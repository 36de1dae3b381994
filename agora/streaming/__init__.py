"""CDC normalisation, alerting and sinks; batch and Structured Streaming forms.

Every transformation here is a plain DataFrame function, so the same code
runs on a static DataFrame (batch replay, oracle checks) and on a streaming
DataFrame from ``readStream``.
"""
