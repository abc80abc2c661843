"""The day sweep as a stream: new observation files are appended as they arrive."""
