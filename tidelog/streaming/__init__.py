"""tidelog.streaming"""
